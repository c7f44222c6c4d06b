"""Queries over the tree of names, attributes, links and quota."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.operators import namespace as N
from cairnstore.operators import quota as Q
from cairnstore.operators import replication as R
from cairnstore.plans.registry import registry
from cairnstore.sources.views import FILES_SQL, MUTATIONS_SQL, files, mutations, table

QUERIES, SQL, query = registry()
_DIRS = f"""{FILES_SQL}, dirs AS (SELECT '/' AS path, NULL AS parent, '' AS name, 0 AS depth
  UNION SELECT DISTINCT '/' || lang, '/', lang, 1 FROM files UNION SELECT DISTINCT dir, '/' || lang, split_part(dir, '/', 3), 2 FROM files)"""
_ENTRIES = f"""{_DIRS}, entries AS (SELECT parent AS dir, name, path, true AS is_dir, CAST(0 AS BIGINT) AS size FROM dirs WHERE depth > 0
  UNION ALL SELECT dir, name, path, false, size FROM files)"""


def entries(spark, sf_dir):
    return N.dentries(files(spark, sf_dir))


@query(f"WITH {_DIRS} SELECT path, parent, name, depth FROM dirs")
def path_tree(spark, sf_dir):
    return N.directories(files(spark, sf_dir)).select("path", "parent", "name", "depth")


@query(f"""WITH RECURSIVE {_ENTRIES}, p AS (SELECT dir, name, octet_length(encode(name)) + 24 AS cost, row_number() OVER (PARTITION BY dir ORDER BY name) AS k FROM entries),
w AS (SELECT dir, name, k, CAST(0 AS BIGINT) AS page, 1 AS n, cost AS filled FROM p WHERE k = 1
  UNION ALL SELECT p.dir, p.name, p.k, w.page + CASE WHEN w.n = 10 OR w.filled + cost > 256 THEN 1 ELSE 0 END, CASE WHEN w.n = 10 OR w.filled + cost > 256 THEN 1 ELSE w.n + 1 END,
    CASE WHEN w.n = 10 OR w.filled + cost > 256 THEN cost ELSE w.filled + cost END FROM w JOIN p ON p.dir = w.dir AND p.k = w.k + 1)
SELECT dir, name, page FROM w""")
def readdir_page(spark, sf_dir):
    """Specified: pages of 10 entries or 256 bytes, in byte order of the names."""
    return N.pages(entries(spark, sf_dir), "dir", "name", F.octet_length("name") + 24, 10, 256).select("dir", "name", "page")


@query(f"WITH {_ENTRIES} SELECT path, CASE WHEN is_dir THEN 'd' ELSE '-' END AS kind, size, name || CASE WHEN is_dir THEN '/' ELSE '' END AS shown FROM entries")
def ls_listing(spark, sf_dir):
    return entries(spark, sf_dir).select("path", F.when(F.col("is_dir"), "d").otherwise("-").alias("kind"), "size", F.concat("name", F.when(F.col("is_dir"), "/").otherwise("")).alias("shown"))


@query(f"WITH {_DIRS} SELECT d.path, 2 + count(s.path) AS nlink FROM dirs d LEFT JOIN dirs s ON s.parent = d.path GROUP BY d.path")
def dir_nlink(spark, sf_dir):
    return N.links(entries(spark, sf_dir))


@query(f"""WITH {FILES_SQL} SELECT path, '/' AS ancestor, CAST(3 AS BIGINT) AS distance FROM files
UNION ALL SELECT path, '/' || lang, 2 FROM files UNION ALL SELECT path, dir, 1 FROM files""")
def ancestors(spark, sf_dir):
    return N.ancestors(files(spark, sf_dir)).select("path", "ancestor", "distance")


@query(f"""WITH RECURSIVE {_ENTRIES}, walk AS (SELECT path, is_dir, size, 1 AS depth FROM entries WHERE dir = '/'
  UNION ALL SELECT e.path, e.is_dir, e.size, depth + 1 FROM walk w JOIN entries e ON e.dir = w.path)
SELECT depth, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM walk GROUP BY depth""")
def reachable_by_level(spark, sf_dir):
    """The walk from the root, as a recursive query."""
    entries(spark, sf_dir).createOrReplaceTempView("cs_entries")
    return spark.sql("""WITH RECURSIVE walk AS (SELECT path, size, 1 AS depth FROM cs_entries WHERE dir = '/'
      UNION ALL SELECT e.path, e.size, depth + 1 FROM walk w JOIN cs_entries e ON e.dir = w.path)
      SELECT depth, count(*) AS entries, sum(size) AS bytes FROM walk GROUP BY depth""")


@query("""SELECT page_id, '/' || array_to_string(list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x NOT IN ('', '.')), '/') AS cleaned FROM pages""")
def path_clean(spark, sf_dir):
    """Page addresses as paths; none of these has a parent part, which tests cover."""
    return table(spark, sf_dir, "pages").select("page_id", N.clean(F.regexp_replace("url", "^[a-z]+://", "/./")).alias("cleaned"))


@query("""SELECT c_custkey, CASE WHEN link THEN 511 WHEN frozen THEN mode & 3949 ELSE mode END AS shown FROM (
  SELECT c_custkey, CAST(c_custkey % 4096 AS INT) AS mode, c_custkey % 5 = 0 AS frozen, c_custkey % 7 = 0 AS link FROM customer)""")
def attr_view(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", N.presented_mode((key % 4096).cast("int"), key % 5 == 0, key % 7 == 0).alias("shown"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 <> 0 THEN m & 1023 ELSE m END AS mode FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey * 13 AS INT) & 4095 ELSE CAST(c_custkey % 4096 AS INT) END AS m FROM customer)""")
def setattr_apply(spark, sf_dir):
    key = F.col("c_custkey")
    new = F.when(key % 2 == 0, (key * 13).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", N.set_attributes((key % 4096).cast("int"), key % 4 == 0, new, key % 3 == 0).alias("mode"))


@query("""SELECT doc_id, CASE WHEN strlen(name) > 255 THEN 'ENAMETOOLONG' WHEN name = '' OR contains(name, '/') THEN 'EINVAL' ELSE 'ok' END AS verdict
FROM (SELECT doc_id, substr(text, 1, CAST(doc_id % 400 AS INT)) AS name FROM documents)""")
def name_limit_check(spark, sf_dir):
    """Names of up to 399 characters: the limit is in bytes."""
    name = F.substring("text", F.lit(1), F.pmod("doc_id", F.lit(400)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", N.name_verdict(name).alias("verdict"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ENOENT' WHEN 1 THEN 'ENOTDIR' WHEN 2 THEN 'ESTALE' WHEN 3 THEN 'EIO' ELSE 'ok' END AS errno FROM customer""")
def errno_lookup(spark, sf_dir):
    which = F.pmod("c_custkey", F.lit(5))
    message = F.when(which == 0, "name: not found").when(which == 1, "x: not a directory").when(which == 2, "errno=ESTALE: old handle").when(which == 3, "disk on fire")
    return table(spark, sf_dir, "customer").select("c_custkey", N.errno(message).alias("errno"))


@query(f"""WITH {MUTATIONS_SQL} SELECT object, arg_max(value, (tm, seq)) AS value, max(tm) AS committed_at, arg_min(holder, (tm, seq)) AS creator, count(*) AS commits
FROM mutations WHERE op IN ('commit', 'create') GROUP BY object""")
def latest_commit_per_name(spark, sf_dir):
    return N.latest_commits(mutations(spark, sf_dir))


@query(f"""WITH {MUTATIONS_SQL}, l AS (SELECT object, holder, arg_max(op, (tm, seq)) AS op FROM mutations WHERE op IN ('create', 'unlink') GROUP BY ALL)
SELECT object, count(*) FILTER (WHERE op = 'create') AS nlink FROM l GROUP BY object""")
def live_links(spark, sf_dir):
    return N.live_links(mutations(spark, sf_dir))


@query(f"""WITH {_ENTRIES} SELECT dir, CAST(row_number() OVER (PARTITION BY dir ORDER BY name) AS BIGINT) AS place, name FROM entries WHERE is_dir""")
def ensure_dirs(spark, sf_dir):
    """Directories that publishing all files must create, in order within their parents."""
    from pyspark.sql import Window

    return entries(spark, sf_dir).where("is_dir").select("dir", F.row_number().over(Window.partitionBy("dir").orderBy("name")).cast("long").alias("place"), "name")


@query(f"WITH {FILES_SQL} SELECT lang, CAST(sum(size) AS BIGINT) AS bytes_used, count(*) AS inodes_used FROM files GROUP BY lang")
def quota_usage(spark, sf_dir):
    return files(spark, sf_dir).groupBy("lang").agg(F.sum("size").alias("bytes_used"), F.count(F.lit(1)).alias("inodes_used"))


_LIMIT = 1000


@query(f"""WITH RECURSIVE {MUTATIONS_SQL}, o AS (SELECT object AS scope, seq, CAST(floor(value * 10) AS BIGINT) * CASE WHEN op = 'unlink' THEN -1 ELSE 1 END AS delta,
  row_number() OVER (PARTITION BY object ORDER BY seq) AS k FROM mutations), w AS (
  SELECT scope, seq, delta, k, NOT (delta > 0 AND delta > {_LIMIT}) AS accepted, CASE WHEN NOT (delta > 0 AND delta > {_LIMIT}) THEN greatest(delta, 0) ELSE 0 END AS used FROM o WHERE k = 1
  UNION ALL SELECT o.scope, o.seq, o.delta, o.k, NOT (o.delta > 0 AND w.used + o.delta > {_LIMIT}),
    CASE WHEN NOT (o.delta > 0 AND w.used + o.delta > {_LIMIT}) THEN greatest(w.used + o.delta, 0) ELSE w.used END FROM w JOIN o ON o.scope = w.scope AND o.k = w.k + 1)
SELECT scope, seq, delta, accepted, CAST(used AS BIGINT) AS used FROM w""")
def quota_admission(spark, sf_dir):
    """The event log as changes of size, admitted in order under a limit per object."""
    delta = F.floor(F.col("value") * 10).cast("long") * F.when(F.col("op") == "unlink", -1).otherwise(1)
    return Q.admitted(mutations(spark, sf_dir).select(F.col("object").alias("scope"), "seq", delta.alias("delta")), "scope", _LIMIT)


@query("""SELECT p_partkey, CASE WHEN bl = 0 THEN 1125899906842624 ELSE bl END AS total_bytes, greatest(0, CASE WHEN bl = 0 THEN 1125899906842624 ELSE bl END - used) AS free_bytes,
  CASE WHEN il = 0 THEN 4294967296 ELSE il END AS total_inodes, greatest(0, CASE WHEN il = 0 THEN 4294967296 ELSE il END - p_partkey) AS free_inodes
FROM (SELECT p_partkey, (p_partkey % 4) * 100000 AS bl, CAST(p_size % 3 AS BIGINT) * 50 AS il, p_partkey * 977 AS used FROM part)""")
def statfs_view(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 4) * 100000).alias("bl"), ((F.col("p_size") % 3).cast("long") * 50).alias("il"), (F.col("p_partkey") * 977).alias("used"))
    return rows.select("p_partkey", *Q.statfs(F.col("bl"), F.col("il"), F.col("used"), F.col("p_partkey")))


@query("""SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', floor(n * 10 / 1024.0) / 10) WHEN n < 1073741824 THEN printf('%.1f MiB', floor(n * 10 / 1048576.0) / 10)
  ELSE printf('%.1f GiB', floor(n * 10 / 1073741824.0) / 10) END AS shown FROM (SELECT p_partkey, p_partkey * p_partkey * 577 AS n FROM part)""")
def human_sizes(spark, sf_dir):
    """Sizes in GiB at most."""
    return table(spark, sf_dir, "part").select("p_partkey", Q.human_bytes(F.col("p_partkey") * F.col("p_partkey") * 577, ("KiB", "MiB", "GiB")).alias("shown"))


@query(f"""WITH {FILES_SQL}, a AS (SELECT '/' AS ancestor, size FROM files UNION ALL SELECT '/' || lang, size FROM files UNION ALL SELECT dir, size FROM files)
SELECT ancestor, CAST(sum(size) AS BIGINT) AS bytes_used, count(*) AS inodes_used FROM a GROUP BY ancestor""")
def subtree_rollup(spark, sf_dir):
    return Q.roll_up(N.ancestors(files(spark, sf_dir)))


@query(f"""WITH {FILES_SQL} SELECT path, CASE WHEN dir IN ('/en/src1', '/en/src2') THEN 'west' WHEN lang = 'en' THEN 'east' ELSE 'north' END AS home FROM files""")
def home_region_prefix(spark, sf_dir):
    homes = spark.createDataFrame([("/", "north"), ("/en", "east"), ("/en/src1", "west"), ("/en/src2", "west")], "prefix string, home string")
    return R.home_regions(files(spark, sf_dir).select("path"), homes)


_CLASSES = "(VALUES ('relaxed'), ('session'), ('posix'), ('immutable'))"


@query(f"""SELECT a.c AS src_class, b.c AS dst_class, x.r_name AS src_region, y.r_name AS dst_region,
  CASE WHEN a.c = 'immutable' OR b.c = 'immutable' THEN 'EROFS' WHEN x.r_name <> y.r_name OR a.c <> b.c THEN 'EXDEV' ELSE 'ok' END AS verdict
FROM {_CLASSES} a(c), {_CLASSES} b(c), region x, region y""")
def boundary_matrix(spark, sf_dir):
    """The rule for every pair of classes and regions: arrays of fixed length are exploded, nothing is joined."""
    classes = F.array(*[F.lit(c) for c in ("relaxed", "session", "posix", "immutable")])
    names = table(spark, sf_dir, "region").agg(F.array_sort(F.collect_list("r_name")).alias("r"))
    each = names.select("r", F.explode("r").alias("src_region")).select("src_region", F.explode("r").alias("dst_region"))
    each = each.select("*", F.explode(classes).alias("src_class")).select("*", F.explode(classes).alias("dst_class"))
    return each.withColumn("verdict", R.boundary(F.col("src_class"), F.col("dst_class"), F.col("src_region"), F.col("dst_region")))


@query(f"""SELECT m AS mode, c AS class, CASE WHEN m = 'ROX' THEN 'ok' WHEN m = 'RWO' THEN CASE WHEN c = 'immutable' THEN 'refused' ELSE 'ok' END
  WHEN c = 'posix' THEN 'ok' WHEN c = 'relaxed' THEN 'disjoint-writers' ELSE 'refused' END AS verdict FROM (VALUES ('ROX'), ('RWO'), ('RWX')) a(m), {_CLASSES} b(c)""")
def access_mode_matrix(spark, sf_dir):
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, ("ROX", "RWO", "RWX")))).alias("mode"))
    one = one.select("mode", F.explode(F.array(*map(F.lit, ("relaxed", "session", "posix", "immutable")))).alias("class"))
    return one.withColumn("verdict", R.access_mode(F.col("mode"), F.col("class")))


@query(f"""WITH {MUTATIONS_SQL}, l AS (SELECT object, holder, arg_max(op, (tm, seq)) AS op, arg_max(amount, (tm, seq)) AS amount FROM (SELECT *, CAST(floor(value * 10) AS BIGINT) AS amount FROM mutations WHERE op IN ('grant', 'commit', 'unlink')) GROUP BY ALL)
SELECT object AS scope, CAST(coalesce(sum(amount) FILTER (WHERE op = 'commit'), 0) AS BIGINT) AS used, CAST(coalesce(sum(amount) FILTER (WHERE op = 'grant'), 0) AS BIGINT) AS reserved FROM l GROUP BY object""")
def quota_reservations(spark, sf_dir):
    """Specified: grants reserve, commits settle, unlinks release."""
    op = F.when(F.col("op") == "grant", "reserve").when(F.col("op") == "commit", "settle").otherwise("release")
    log = mutations(spark, sf_dir).where("op IN ('grant', 'commit', 'unlink')")
    return Q.reservations(log.select(F.col("object").alias("scope"), "holder", "at", "seq", op.alias("op"), F.floor(F.col("value") * 10).cast("long").alias("amount")))
