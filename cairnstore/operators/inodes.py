"""Inodes: ids, lookups, records, publication, special files, and a replay of namespace operations with their refusals."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnstore.operators import namespace as N

ROOT = 1
#: Permission bits of new directories and of symbolic links.
DIR_MODE, LINK_MODE = 0o755, 0o777


def allocate(files: DataFrame) -> DataFrame:
    """path, dir, name, is_dir, size and inode of every entry, the root (inode 1) included.

    Ids are consecutive: directories by path, then files by (dir, name).  The one window without a key is
    over directories; files are ranked within theirs and shifted by the files of the directories before.
    """
    folders = N.directories(files).select("path", F.col("parent").alias("dir"), "name")
    folders = folders.withColumn("inode", F.row_number().over(Window.orderBy("path")).cast("long"))
    held = files.groupBy("dir").agg(F.count(F.lit(1)).alias("_n"))
    total = folders.agg(F.max("inode").alias("_dirs"))
    before = held.select("dir", F.coalesce(F.sum("_n").over(Window.orderBy("dir").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = files.select("path", "dir", "name", "size", F.row_number().over(Window.partitionBy("dir").orderBy("name")).alias("_rank")).join(before, "dir")
    # One row: the number of directories.
    ranked = ranked.crossJoin(F.broadcast(total)).select("path", "dir", "name", F.lit(False).alias("is_dir"), "size", (F.col("_dirs") + F.col("_before") + F.col("_rank")).alias("inode"))
    return folders.select("path", "dir", "name", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), "inode").unionByName(ranked)


def lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``requests`` (parent, name, ...) with inode and verdict: ENOENT if the directory has no such name."""
    bound = entries.select("parent", "name", "inode")
    return requests.join(bound, ["parent", "name"], "left").withColumn("verdict", F.when(F.col("inode").isNull(), "ENOENT").otherwise("ok"))


def resolve(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``requests`` with a path: the inode that its cleaned form names; links aren't followed, nothing is below a file."""
    cleaned = requests.withColumn("cleaned", N.clean(F.col("requested")))
    found = cleaned.join(entries.select(F.col("path").alias("cleaned"), "inode", "is_dir"), "cleaned", "left")
    return found.withColumn("verdict", F.when(F.col("inode").isNull(), "ENOENT").otherwise("ok"))


def point_reads(log: DataFrame) -> DataFrame:
    """For each read of a log of puts, deletes and reads of records: whether the record is there."""
    seen = Window.partitionBy("object").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last_value(F.when(F.col("op") != "get", F.struct("op", "seq")), True).over(seen)
    found = log.withColumn("_last", last).where("op = 'get'")
    there = F.coalesce(F.col("_last.op") == "put", F.lit(False))
    return found.select("seq", "object", F.when(there, F.col("_last.seq")).alias("written_by"), F.when(there, "ok").otherwise("ENOENT").alias("verdict"))


def publish(requests: DataFrame, bound: DataFrame) -> DataFrame:
    """``requests`` (dir, name, seq, size) with verdict and charge: the first to publish a free name gets it.

    A name is never rebound; what is refused is charged nothing.  A name's first request is an aggregate
    that combines before its shuffle, so a name that many ask for is no hot key.
    """
    first = requests.groupBy("dir", "name").agg(F.min("seq").alias("_first"))
    taken = first.join(bound.select("dir", "name", F.lit(True).alias("_bound")), ["dir", "name"], "left")
    won = taken.where("_bound IS NULL").select(F.col("_first").alias("seq"), F.lit(True).alias("_won"))
    judged = requests.join(won, "seq", "left")
    ok = F.col("_won").isNotNull()
    zero = F.lit(0).cast("long")
    return judged.select(
        "seq", "dir", "name", F.when(ok, "ok").otherwise("EEXIST").alias("verdict"), F.when(ok, F.col("size")).otherwise(zero).alias("bytes_charged"), F.when(ok, F.lit(1).cast("long")).otherwise(zero).alias("inodes_charged")
    )


def charged_directories(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Per directory that must be made above ``files``: its parent and the inode that it costs."""
    wanted = N.directories(files).where("depth > 0")
    return wanted.join(existing.select("path"), "path", "left_anti").select("path", "parent", F.lit(1).cast("long").alias("inodes_charged"))


def special(kind: Column, target: Column) -> list[Column]:
    """mode, size and verdict of a new link, fifo, socket or device; a regular file is refused."""
    link = kind == "link"
    return [
        F.when(link, F.lit(LINK_MODE)).otherwise(F.lit(0o644)).alias("mode"), F.when(link, F.octet_length(target)).otherwise(0).cast("long").alias("size"),
        F.when(kind == "regular", "EPERM").otherwise("ok").alias("verdict"),
    ]


def readlink(kind: Column, target: Column) -> list[Column]:
    return [F.when(kind == "link", target).alias("target"), F.when(kind == "link", "ok").otherwise("EINVAL").alias("verdict")]


def detached_commits(updates: DataFrame, unlinked: DataFrame, pinned: DataFrame) -> DataFrame:
    """``updates`` (inode, size, at) of inodes without a name: taken if a handle is open, else the inode is gone.

    A detached commit changes content, size and times; it binds no name, charges nothing and keeps nlink.
    """
    found = updates.join(unlinked.select("inode", F.lit(True).alias("_gone")), "inode", "left").join(pinned.select("inode", F.lit(True).alias("_open")), "inode", "left")
    how = F.when(F.col("_gone").isNull(), "bound").when(F.col("_open"), "detached").otherwise("ENOENT")
    done = how != "ENOENT"
    return found.select(
        "inode", how.alias("how"), F.when(done, F.col("size")).alias("size"), F.when(done, F.col("at")).alias("mtime"), F.when(how == "detached", F.lit(0)).when(how == "bound", F.lit(1)).cast("long").alias("nlink")
    )


def first_settings(log: DataFrame) -> DataFrame:
    """Per object: the class and chunk size that came first; later ones are ignored."""
    return log.groupBy("object").agg(F.min_by(F.struct("class", "chunk_size"), F.struct("at", "seq")).alias("s"), F.count(F.lit(1)).alias("offered")).select("object", "s.class", "s.chunk_size", "offered")


class _Tree:
    """The names of one subtree: what is bound where, and what each inode is."""

    def __init__(self):
        self.names: dict[tuple[int, str], int] = {}
        self.is_dir: dict[int, bool] = {ROOT: True}
        self.parent: dict[int, int] = {}
        self.held: dict[int, int] = {}  # entries of a directory
        self.links: dict[int, int] = {}
        self.buried: int | None = None  # what the last operation left without a name

    def folder(self, name: str) -> int | str:
        """The directory of the top level with this name; the root without one."""
        found = self.names.get((ROOT, name)) if name else ROOT
        return "ENOENT" if found is None else found if self.is_dir[found] else "ENOTDIR"

    def bind(self, at: int, name: str, inode: int) -> None:
        self.names[at, name] = inode
        self.held[at] = self.held.get(at, 0) + 1
        self.links[inode] = self.links.get(inode, 0) + 1
        if self.is_dir[inode]:
            self.parent[inode] = at

    def unbind(self, at: int, name: str) -> int:
        inode = self.names.pop((at, name))
        self.held[at] -= 1
        self.links[inode] -= 1
        return inode

    def drop(self, at: int, name: str) -> int:
        """Unbind a name for good: an inode without another goes to the graveyard."""
        inode = self.unbind(at, name)
        if not self.links[inode]:
            self.buried = inode
        return inode

    def below(self, inode: int, top: int) -> bool:
        while inode != ROOT:
            if inode == top:
                return True
            inode = self.parent[inode]
        return False

    def apply(self, op: str, new: int, folder: str, name: str, folder2: str, name2: str) -> tuple[str, int | None]:
        """(verdict, the inode that is made, bound or dropped)."""
        self.buried = None
        at = self.folder(folder)
        if isinstance(at, str):
            return at, None
        there = self.names.get((at, name))
        if op in ("create", "mkdir", "commit"):
            if there is not None:
                return ("EISDIR" if self.is_dir[there] else "ok", there) if op == "commit" else ("EEXIST", there)
            self.is_dir[new] = op == "mkdir"
            self.bind(at, name, new)
            return "ok", new
        if there is None:
            return "ENOENT", None
        if op == "unlink":
            return ("EISDIR", there) if self.is_dir[there] else ("ok", self.drop(at, name))
        if op == "rmdir":
            if not self.is_dir[there]:
                return "ENOTDIR", there
            return ("ENOTEMPTY", there) if self.held.get(there) else ("ok", self.drop(at, name))
        if op == "rename" and (folder, name) == (folder2, name2):
            return "ok", there
        to = self.folder(folder2)
        if isinstance(to, str):
            return to, there
        target = self.names.get((to, name2))
        if op == "link":
            if self.is_dir[there]:
                return "EPERM", there
            if target is not None:
                return "EEXIST", there
            self.bind(to, name2, there)
            return "ok", there
        if self.is_dir[there] and self.below(to, there):
            return "EINVAL", there
        if target is not None:
            if self.is_dir[target] != self.is_dir[there]:
                return "EISDIR" if self.is_dir[target] else "ENOTDIR", there
            if self.is_dir[target] and self.held.get(target):
                return "ENOTEMPTY", there
            self.drop(to, name2)
        self.unbind(at, name)
        self.bind(to, name2, there)
        return "ok", there

    def nlink(self, inode: int) -> int:
        if not self.is_dir[inode]:
            return self.links[inode]
        return 2 + sum(1 for (at, _), i in self.names.items() if at == inode and self.is_dir[i])


_EVENTS = "subtree long, seq long, verdict string, inode long, buried long"
_BOUND = "subtree long, parent long, name string, inode long, is_dir boolean, nlink long"


def _replayer(final: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, last = _Tree(), None

        def bound() -> pa.RecordBatch:
            rows = [(last, at, name, i, tree.is_dir[i], tree.nlink(i)) for (at, name), i in tree.names.items()]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["subtree", "parent", "name", "inode", "is_dir", "nlink"])

        for batch in batches:
            done = []
            for subtree, seq, *rest in zip(*(batch.column(c).to_pylist() for c in ("subtree", "seq", "op", "folder", "name", "folder2", "name2"))):
                if subtree != last:
                    if final and last is not None:
                        yield bound()
                    tree, last = _Tree(), subtree
                done.append((subtree, seq, *tree.apply(rest[0], seq + 1 + ROOT, *rest[1:]), tree.buried))
            if not final and done:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["subtree", "seq", "verdict", "inode", "buried"])
        if final and last is not None:
            yield bound()

    return run


def replay(log: DataFrame, final: bool = False) -> DataFrame:
    """What each operation of a log (subtree, seq, op, folder, name, folder2, name2) gives, or what is bound at its end.

    Operations are create, mkdir, commit (create or overwrite), link, unlink, rmdir and rename, with their
    refusals.  Each depends on all before it in its subtree, so a subtree is one fold: its rows stream through
    the task in order, and the state is its names, not its log.  A new inode is numbered by its operation.
    """
    ordered = log.repartition("subtree").sortWithinPartitions("subtree", "seq")
    return ordered.mapInArrow(_replayer(final), _BOUND if final else _EVENTS)


def folder_times(log: DataFrame, buckets: int) -> DataFrame:
    """mtime and ctime of each directory: the last time that an entry was added or removed."""
    changed = log.where(F.col("op").isin("create", "unlink"))
    return changed.groupBy(F.pmod("object", F.lit(buckets)).alias("dir")).agg(F.max("at").alias("mtime"), F.max("at").alias("ctime"), F.count(F.lit(1)).alias("changes"))
