"""The tree of names: paths, directories, links and attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairnstore.operators.folds import fold

NAME_MAX = 255
#: Errors by their meaning.
ERRNO = {"not found": "ENOENT", "exists": "EEXIST", "not a directory": "ENOTDIR", "is a directory": "EISDIR", "not empty": "ENOTEMPTY", "quota exceeded": "EDQUOT", "read-only": "EROFS", "name too long": "ENAMETOOLONG"}


def clean(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` parts, by name alone."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def directories(files: DataFrame) -> DataFrame:
    """Every directory above a file: path, parent, name, depth; the root has depth 0 and no parent."""
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("path"), n.alias("depth")))
    each = files.select("dir").distinct().select(F.inline(prefixes)).distinct()
    return each.withColumns({
        "parent": F.when(F.col("depth") > 0, F.coalesce(F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("/"))),
        "name": F.when(F.col("depth") > 0, F.regexp_extract("path", "([^/]*)$", 1)).otherwise(F.lit("")),
    })


def dentries(files: DataFrame) -> DataFrame:
    """dir, name, path, is_dir and size of every entry of the tree, without the root."""
    folders = directories(files).where("depth > 0").select(F.col("parent").alias("dir"), "name", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"))
    return folders.unionByName(files.select("dir", "name", "path", F.lit(False).alias("is_dir"), "size"))


def page(entries: DataFrame, cursor: str, limit: int, order: str = "name") -> DataFrame:
    """The first ``limit`` entries strictly after ``cursor``; all if the limit is 0 or less."""
    found = entries.where(F.col(order) > cursor).orderBy(order)
    return found.limit(limit) if limit > 0 else found


def pages(entries: DataFrame, group: str, order: str, cost: Column, rows: int, size: int) -> DataFrame:
    """Adds page: a page ends before the entry that would be its ``rows`` + 1st or take it past ``size`` bytes."""

    def step(page: list[int], n: int) -> tuple:
        if page[1] and (page[1] == rows or page[2] + n > size):
            page[:] = [page[0] + 1, 0, 0]
        page[1:] = [page[1] + 1, page[2] + n]
        return (page[0],)

    costed = entries.withColumn("_cost", cost.cast("long"))
    return fold(costed, group, [order], ["_cost"], lambda: [0, 0, 0], step, "page long").drop("_cost")


def links(entries: DataFrame) -> DataFrame:
    """nlink of each directory: two and one for each subdirectory."""
    sub = entries.where("is_dir").groupBy(F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    every = entries.where("is_dir").select("path").unionByName(entries.select(F.lit("/").alias("path")).limit(1))
    return every.join(sub, "path", "left").select("path", (2 + F.coalesce("n", F.lit(0))).alias("nlink"))


def ancestors(files: DataFrame) -> DataFrame:
    """Every (path, ancestor, distance) above a file, the root included."""
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    each = F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")).alias("ancestor"), (F.size(parts) - n + 1).cast("long").alias("distance")),
    )
    return files.select("path", "size", F.inline(each))


def name_verdict(name: Column) -> Column:
    return F.when(F.octet_length(name) > NAME_MAX, "ENAMETOOLONG").when((name == "") | name.contains("/"), "EINVAL").otherwise("ok")


def errno(message: Column) -> Column:
    """The error of a message ``errno=NAME: ...``, else that of its meaning, else EIO."""
    out = F.nullif(F.regexp_extract(message, "^errno=([A-Z]+): ", 1), F.lit(""))
    known = F.coalesce(*[F.when(message.contains(k), v) for k, v in ERRNO.items()])
    return F.when(message.isNull(), F.lit("ok")).otherwise(F.coalesce(out, known, F.lit("EIO")))


def set_attributes(mode: Column, is_dir: Column, new_mode: Column, chown: Column) -> Column:
    """The mode after a change: only the low twelve bits; a change of owner clears setuid and setgid of files."""
    wanted = F.coalesce(new_mode.bitwiseAND(F.lit(0o7777)), mode)
    return F.when(chown & ~is_dir, wanted.bitwiseAND(F.lit(0o7777 & ~0o6000))).otherwise(wanted)


def presented_mode(mode: Column, immutable: Column, symlink: Column) -> Column:
    """What a client sees: symbolic links are 0777, immutable files lose their write bits."""
    return F.when(symlink, F.lit(0o777)).when(immutable, mode.bitwiseAND(F.lit(0o7777 & ~0o222))).otherwise(mode)


def latest_commits(log: DataFrame) -> DataFrame:
    """Per object: the last commit's value and time, and the number of commits; creation keeps its holder."""
    log = log.where(F.col("op").isin("commit", "create"))
    order = F.struct("at", "seq")
    return log.groupBy("object").agg(
        F.max_by("value", order).alias("value"), F.max("at").alias("committed_at"), F.min_by("holder", order).alias("creator"), F.count(F.lit(1)).alias("commits")
    )


def live_links(log: DataFrame) -> DataFrame:
    """nlink of each object: one per holder whose last create or unlink was a create."""
    log = log.where(F.col("op").isin("create", "unlink"))
    last = log.groupBy("object", "holder").agg(F.max_by("op", F.struct("at", "seq")).alias("op"))
    return last.groupBy("object").agg(F.count_if(F.col("op") == "create").alias("nlink"))
