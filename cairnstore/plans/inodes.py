"""Queries over inodes: ids, lookups, publication, special files, and replays of namespace operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.operators import inodes as I
from cairnstore.plans.namespace import _DIRS
from cairnstore.plans.registry import registry
from cairnstore.sources.views import FILES_SQL, MUTATIONS_SQL, files, mutations, table

QUERIES, SQL, query = registry()
_TREE = f"""{_DIRS}, tree AS (
  SELECT path, parent AS dir, name, true AS is_dir, CAST(0 AS BIGINT) AS size, row_number() OVER (ORDER BY path) AS inode FROM dirs
  UNION ALL SELECT path, dir, name, false, size, (SELECT count(*) FROM dirs) + row_number() OVER (ORDER BY dir, name) FROM files),
entries AS (SELECT p.inode AS parent, t.name, t.inode, t.is_dir, t.path FROM tree t JOIN tree p ON t.dir = p.path)"""


def _tree(spark, sf_dir):
    return I.allocate(files(spark, sf_dir))


def _entries(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return tree.join(tree.where("is_dir").select(F.col("path").alias("dir"), F.col("inode").alias("parent")), "dir").select("parent", "name", "inode", "is_dir", "path")


@query(f"WITH {_TREE} SELECT path, is_dir, CAST(inode AS BIGINT) AS inode FROM tree")
def inode_ids(spark, sf_dir):
    return _tree(spark, sf_dir).select("path", "is_dir", "inode")


@query(f"""WITH {_TREE}, r AS (SELECT doc_id, p.inode AS parent, CASE WHEN doc_id % 3 = 0 THEN f.name || '~' ELSE f.name END AS name FROM files f JOIN tree p ON p.path = f.dir)
SELECT doc_id, CAST(r.parent AS BIGINT) AS parent, r.name, CAST((SELECT min(inode) FROM entries e WHERE e.parent = r.parent AND e.name = r.name) AS BIGINT) AS inode,
  CASE WHEN doc_id % 3 = 0 THEN 'ENOENT' ELSE 'ok' END AS verdict FROM r""")
def lookup_entries(spark, sf_dir):
    """Every file is looked up in its directory, a third of them by a name that isn't there."""
    parents = _tree(spark, sf_dir).where("is_dir").select(F.col("path").alias("dir"), F.col("inode").alias("parent"))
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("name", F.lit("~"))).otherwise(F.col("name"))
    requests = files(spark, sf_dir).select("doc_id", "dir", name.alias("name")).join(parents, "dir").drop("dir")
    return I.lookup(requests, _entries(spark, sf_dir)).select("doc_id", "parent", "name", "inode", "verdict")


@query(f"""WITH {_TREE} SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 4 = 2 THEN CAST(d.inode AS BIGINT) ELSE CAST(e.inode AS BIGINT) END AS inode,
  CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id % 4 = 2 END AS is_dir, CASE WHEN doc_id % 4 = 3 THEN 'ENOENT' ELSE 'ok' END AS verdict
FROM files f JOIN tree d ON d.path = f.dir JOIN entries e ON e.parent = d.inode AND e.name = f.name""")
def resolve_paths(spark, sf_dir):
    """Paths with empty, ``.`` and ``..`` parts, of files and directories; a fourth go on below a file."""
    every = files(spark, sf_dir)
    k = F.col("doc_id") % 4
    odd = F.when(k == 0, F.concat(F.lit("//"), "lang", F.lit("/./x/../"), F.element_at(F.split("dir", "/"), 3), F.lit("/"), "name"))
    odd = odd.when(k == 1, F.col("path")).when(k == 2, F.concat("path", F.lit("/.."))).otherwise(F.concat("path", F.lit("/below")))
    return I.resolve(every.select("doc_id", odd.alias("requested")), _tree(spark, sf_dir)).select("doc_id", "inode", "is_dir", "verdict")


@query(f"""WITH {_TREE} SELECT r.inode, t.path, CASE WHEN t.is_dir THEN 493 WHEN t.path IS NOT NULL THEN 420 END AS mode, t.size, CASE WHEN t.path IS NULL THEN 'ENOENT' ELSE 'ok' END AS verdict
FROM (SELECT doc_id * 2 AS inode FROM files) r LEFT JOIN tree t USING (inode)""")
def stat_inodes(spark, sf_dir):
    """Point reads of records by inode; about half of the numbers name none."""
    asked = files(spark, sf_dir).select((F.col("doc_id") * 2).alias("inode"))
    mode = F.when(F.col("is_dir"), I.DIR_MODE).when(F.col("path").isNotNull(), 0o644)
    return asked.join(_tree(spark, sf_dir), "inode", "left").select("inode", "path", mode.alias("mode"), "size", F.when(F.col("path").isNull(), "ENOENT").otherwise("ok").alias("verdict"))


@query("""WITH log AS (SELECT event_id AS seq, epoch_us(ts) AS tm, CAST(json_extract_string(props, '$.k') AS BIGINT) AS object,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete' ELSE 'get' END AS op FROM events),
w AS (SELECT l.seq, l.object, (SELECT max((p.tm, p.seq)) FROM log p WHERE p.object = l.object AND p.op <> 'get' AND (p.tm, p.seq) < (l.tm, l.seq)) AS last FROM log l WHERE op = 'get')
SELECT w.seq, w.object, CASE WHEN p.op = 'put' THEN p.seq END AS written_by, CASE WHEN p.op = 'put' THEN 'ok' ELSE 'ENOENT' END AS verdict FROM w LEFT JOIN log p ON p.object = w.object AND p.op <> 'get' AND (p.tm, p.seq) = w.last""")
def inode_point_reads(spark, sf_dir):
    op = F.when(F.col("op").isin("commit", "create"), "put").when(F.col("op") == "unlink", "delete").otherwise("get")
    return I.point_reads(mutations(spark, sf_dir).withColumn("op", op))


@query(f"""WITH {FILES_SQL}, r AS (SELECT doc_id AS seq, dir, 'f' || (doc_id % 50) AS name, size FROM files), b AS (SELECT DISTINCT dir, 'f7' AS name FROM files),
k AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY seq) = 1 AND name <> 'f7' AS won FROM r)
SELECT seq, dir, name, CASE WHEN won THEN 'ok' ELSE 'EEXIST' END AS verdict, CASE WHEN won THEN size ELSE 0 END AS bytes_charged, CAST(won AS BIGINT) AS inodes_charged FROM k""")
def publish_files(spark, sf_dir):
    """Requests for fifty names in each directory, one of which is taken before."""
    every = files(spark, sf_dir)
    requests = every.select(F.col("doc_id").alias("seq"), "dir", F.concat(F.lit("f"), F.col("doc_id") % 50).alias("name"), "size")
    return I.publish(requests, every.select("dir", F.lit("f7").alias("name")).distinct())


@query(f"WITH {_DIRS} SELECT path, parent, CAST(1 AS BIGINT) AS inodes_charged FROM dirs WHERE depth > 0 AND path NOT LIKE '/en%'")
def ensure_dirs_charged(spark, sf_dir):
    """Publishing all files where the English tree exists."""
    every = files(spark, sf_dir)
    from cairnstore.operators.namespace import directories

    return I.charged_directories(every, directories(every.where("lang = 'en'")))


_KINDS = "(['link', 'fifo', 'socket', 'device', 'regular'])[CAST(doc_id % 5 AS INT) + 1]"
_SPECIAL = f"s AS (SELECT doc_id, {_KINDS} AS kind, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 40) END AS target FROM documents)"


def _special(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("link", "fifo", "socket", "device", "regular"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 40)).alias("target"))


@query(f"WITH {_SPECIAL} SELECT doc_id, kind, CASE kind WHEN 'link' THEN 511 ELSE 420 END AS mode, CAST(CASE kind WHEN 'link' THEN strlen(target) ELSE 0 END AS BIGINT) AS size, CASE kind WHEN 'regular' THEN 'EPERM' ELSE 'ok' END AS verdict FROM s")
def special_files(spark, sf_dir):
    return _special(spark, sf_dir).select("doc_id", "kind", *I.special(F.col("kind"), F.col("target")))


@query(f"WITH {_SPECIAL} SELECT doc_id, target, CASE kind WHEN 'link' THEN 'ok' ELSE 'EINVAL' END AS verdict FROM s")
def read_links(spark, sf_dir):
    return _special(spark, sf_dir).select("doc_id", *I.readlink(F.col("kind"), F.col("target")))


@query("""SELECT doc_id AS inode, CASE WHEN doc_id % 10 NOT IN (3, 7) THEN 'bound' WHEN doc_id % 70 = 7 THEN 'detached' ELSE 'ENOENT' END AS how,
  CASE WHEN doc_id % 10 IN (3, 7) AND doc_id % 70 <> 7 THEN NULL ELSE doc_id * 2 END AS size, CASE WHEN doc_id % 10 IN (3, 7) AND doc_id % 70 <> 7 THEN NULL ELSE doc_id + 9 END AS mtime,
  CAST(CASE WHEN doc_id % 10 NOT IN (3, 7) THEN 1 WHEN doc_id % 70 = 7 THEN 0 END AS BIGINT) AS nlink FROM documents WHERE doc_id % 2 = 1""")
def detached_commits(spark, sf_dir):
    """Commits to odd inodes, of which some lost their name and some of these are held open."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("inode"))
    updates = docs.where("inode % 2 = 1").select("inode", (F.col("inode") * 2).alias("size"), (F.col("inode") + 9).alias("at"))
    return I.detached_commits(updates, docs.where("inode % 10 IN (3, 7)"), docs.where("inode % 70 = 7"))


@query(f"""WITH {MUTATIONS_SQL} SELECT object, first(class ORDER BY tm, seq) AS class, first(chunk_size ORDER BY tm, seq) AS chunk_size, count(*) AS offered
FROM (SELECT *, (['relaxed', 'session', 'posix'])[CAST(holder % 3 AS INT) + 1] AS class, 4096 * (1 + seq % 4) AS chunk_size FROM mutations WHERE op IN ('create', 'commit')) GROUP BY object""")
def first_writer_settings(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("relaxed", "session", "posix"))), (F.col("holder") % 3 + 1).cast("int"))
    log = mutations(spark, sf_dir).where("op IN ('create', 'commit')")
    return I.first_settings(log.select("object", "at", "seq", kind.alias("class"), (4096 * (1 + F.col("seq") % 4)).alias("chunk_size")))


_OPS = ("create", "create", "mkdir", "rename", "link", "unlink", "rmdir", "commit", "mkdir", "rename", "create")
_LOG = """log AS (SELECT event_id AS seq, event_id % 40 AS subtree, (['create', 'create', 'mkdir', 'rename', 'link', 'unlink', 'rmdir', 'commit', 'mkdir', 'rename', 'create'])[CAST(a % 11 AS INT) + 1] AS op,
  CASE WHEN b % 3 = 0 THEN 'd' || (b // 3 % 3) ELSE '' END AS folder, CASE WHEN a % 11 IN (2, 6, 8) OR c % 2 = 0 THEN 'd' || (c // 2 % 3) ELSE 'n' || (c // 2 % 5) END AS name,
  CASE WHEN d % 2 = 0 THEN 'd' || (d // 2 % 3) ELSE '' END AS folder2, CASE WHEN e % 2 = 0 THEN 'd' || (e // 2 % 3) ELSE 'n' || (e // 2 % 5) END AS name2
  FROM (SELECT event_id, event_id * 7919 // 40 % 1009 AS a, event_id * 104729 // 40 % 1013 AS b, event_id * 1299709 // 40 % 1019 AS c, event_id * 15485863 // 40 % 1021 AS d, event_id * 32452843 // 40 % 1031 AS e FROM events))"""
_ENTRY = "STRUCT(p BIGINT, n VARCHAR, i BIGINT, d BOOLEAN)"
#: The oracle's replay: a recursive walk over each subtree's operations, the bindings in a list.
_REPLAY = f"""RECURSIVE {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY subtree ORDER BY seq) AS k FROM log), walk AS (
  SELECT subtree, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS BIGINT) AS inode, CAST(NULL AS BIGINT) AS buried, CAST([] AS {_ENTRY}[]) AS s FROM (SELECT DISTINCT subtree FROM log)
  UNION ALL
  SELECT subtree, k, seq, v, i, CASE WHEN v <> 'ok' OR same THEN NULL WHEN op IN ('unlink', 'rmdir') AND len(list_filter(s, lambda x: x.i = there.i)) = 1 THEN there.i
    WHEN op = 'rename' AND there2 IS NOT NULL AND len(list_filter(s, lambda x: x.i = there2.i)) = 1 THEN there2.i END, CASE WHEN v <> 'ok' OR same THEN s WHEN op IN ('create', 'mkdir', 'commit') THEN CASE WHEN there IS NULL THEN list_append(s, {{'p': par, 'n': name, 'i': seq + 2, 'd': op = 'mkdir'}}) ELSE s END
    WHEN op = 'link' THEN list_append(s, {{'p': par2, 'n': name2, 'i': there.i, 'd': false}})
    WHEN op = 'rename' THEN list_append(list_filter(s, lambda x: NOT (x.p = par AND x.n = name) AND NOT (x.p = par2 AND x.n = name2)), {{'p': par2, 'n': name2, 'i': there.i, 'd': there.d}})
    ELSE list_filter(s, lambda x: NOT (x.p = par AND x.n = name)) END
  FROM (SELECT *, CASE WHEN e1 IS NOT NULL THEN NULL WHEN op IN ('create', 'mkdir', 'commit') AND there IS NULL THEN seq + 2 ELSE there.i END AS i,
      CASE WHEN e1 IS NOT NULL THEN e1 WHEN op = 'commit' THEN CASE WHEN there.d THEN 'EISDIR' ELSE 'ok' END WHEN op IN ('create', 'mkdir') THEN CASE WHEN there IS NULL THEN 'ok' ELSE 'EEXIST' END
        WHEN there IS NULL THEN 'ENOENT' WHEN op = 'unlink' THEN CASE WHEN there.d THEN 'EISDIR' ELSE 'ok' END
        WHEN op = 'rmdir' THEN CASE WHEN NOT there.d THEN 'ENOTDIR' WHEN list_bool_or(list_transform(s, lambda x: x.p = there.i)) THEN 'ENOTEMPTY' ELSE 'ok' END
        WHEN same THEN 'ok' WHEN e2 IS NOT NULL THEN e2 WHEN op = 'link' THEN CASE WHEN there.d THEN 'EPERM' WHEN there2 IS NOT NULL THEN 'EEXIST' ELSE 'ok' END
        WHEN there.d AND (par2 = there.i OR list_bool_or(list_transform(s, lambda x: x.i = par2 AND x.p = there.i))) THEN 'EINVAL' WHEN there2 IS NULL THEN 'ok' WHEN there2.d AND NOT there.d THEN 'EISDIR' WHEN there.d AND NOT there2.d THEN 'ENOTDIR'
        WHEN there2.d AND list_bool_or(list_transform(s, lambda x: x.p = there2.i)) THEN 'ENOTEMPTY' ELSE 'ok' END AS v
    FROM (SELECT *, list_filter(s, lambda x: x.p = par AND x.n = name)[1] AS there, list_filter(s, lambda x: x.p = par2 AND x.n = name2)[1] AS there2, op = 'rename' AND folder = folder2 AND name = name2 AS same
      FROM (SELECT o.subtree, o.k, o.seq, o.op, o.folder, o.name, o.folder2, o.name2, w.s,
          CASE WHEN folder = '' THEN 1 ELSE list_filter(w.s, lambda x: x.p = 1 AND x.n = folder AND x.d)[1].i END AS par, CASE WHEN folder2 = '' THEN 1 ELSE list_filter(w.s, lambda x: x.p = 1 AND x.n = folder2 AND x.d)[1].i END AS par2,
          CASE WHEN folder <> '' THEN CASE WHEN len(list_filter(w.s, lambda x: x.p = 1 AND x.n = folder)) = 0 THEN 'ENOENT' WHEN len(list_filter(w.s, lambda x: x.p = 1 AND x.n = folder AND x.d)) = 0 THEN 'ENOTDIR' END END AS e1,
          CASE WHEN folder2 <> '' THEN CASE WHEN len(list_filter(w.s, lambda x: x.p = 1 AND x.n = folder2)) = 0 THEN 'ENOENT' WHEN len(list_filter(w.s, lambda x: x.p = 1 AND x.n = folder2 AND x.d)) = 0 THEN 'ENOTDIR' END END AS e2
        FROM walk w JOIN o ON o.subtree = w.subtree AND o.k = w.k + 1))))"""


def _log(spark, sf_dir):
    """The events read as namespace operations of forty subtrees, with few names so that they meet."""
    n = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    part = lambda prime, size: F.expr(f"(seq * {prime} div 40) % {size}")
    n = n.select("seq", (F.col("seq") % 40).alias("subtree"), *(part(p, s).alias(c) for c, p, s in (("a", 7919, 1009), ("b", 104729, 1013), ("c", 1299709, 1019), ("d", 15485863, 1021), ("e", 32452843, 1031))))
    text = lambda prefix, c, by, most: F.concat(F.lit(prefix), F.expr(f"({c} div {by}) % {most}").cast("string"))
    either = lambda when, c: F.when(when, text("d", c, 2, 3)).otherwise(text("n", c, 2, 5))
    a = F.col("a") % 11
    return n.select(
        "seq", "subtree", F.element_at(F.array(*map(F.lit, _OPS)), (a + 1).cast("int")).alias("op"), F.when(F.col("b") % 3 == 0, text("d", "b", 3, 3)).otherwise("").alias("folder"),
        either(a.isin(2, 6, 8) | (F.col("c") % 2 == 0), "c").alias("name"), F.when(F.col("d") % 2 == 0, text("d", "d", 2, 3)).otherwise("").alias("folder2"), either(F.col("e") % 2 == 0, "e").alias("name2"),
    )


@query(f"WITH {_REPLAY} SELECT subtree, seq, verdict, inode, buried FROM walk WHERE k > 0")
def namespace_replay(spark, sf_dir):
    """The verdict on each create, mkdir, commit, link, unlink, rmdir and rename, in order, and what it sends to the graveyard."""
    return I.replay(_log(spark, sf_dir))


@query(f"""WITH {_REPLAY}, b AS (SELECT subtree, unnest(s, recursive := true) FROM (SELECT *, k = max(k) OVER (PARTITION BY subtree) AS last FROM walk) WHERE last)
SELECT subtree, p AS parent, n AS name, i AS inode, d AS is_dir, CASE WHEN d THEN 2 + (SELECT count(*) FROM b c WHERE c.subtree = b.subtree AND c.p = b.i AND c.d) ELSE (SELECT count(*) FROM b c WHERE c.subtree = b.subtree AND c.i = b.i) END AS nlink FROM b""")
def namespace_bindings(spark, sf_dir):
    """What the replay leaves bound, with link counts."""
    return I.replay(_log(spark, sf_dir), final=True)


@query(f"""WITH {MUTATIONS_SQL} SELECT object % 25 AS dir, max(tm) AS mtime, max(tm) AS ctime, count(*) AS changes FROM mutations WHERE op IN ('create', 'unlink') GROUP BY 1""")
def folder_times(spark, sf_dir):
    return I.folder_times(mutations(spark, sf_dir), 25)
