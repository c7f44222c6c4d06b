"""Queries over dedup, containers and locators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cairnstore.functions.binary import joined_bytes
from cairnstore.operators import content as C
from cairnstore.operators import namespace as N
from cairnstore.operators import packing as P
from cairnstore.operators import replication as R
from cairnstore.plans.registry import registry
from cairnstore.sources.views import FILES_SQL, chunks_sql, files, table

QUERIES, SQL, query = registry()
SEAL = 65536
_CHUNKS = f"{FILES_SQL}, {chunks_sql(1024)}"
_UNIQUE = f"{_CHUNKS}, u AS (SELECT lang, chunk_id, path, idx, length FROM chunks QUALIFY row_number() OVER (PARTITION BY lang, chunk_id ORDER BY path, idx) = 1)"
#: The oracle's greedy fold: a recursive walk over each group's rows in order.
PACKED_SQL = f"""{_UNIQUE}, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY path, idx) AS k FROM u), packed AS (
  SELECT lang, chunk_id, path, idx, length, k, CAST(0 AS BIGINT) AS container_no, CAST(0 AS BIGINT) AS "offset", length AS filled FROM o WHERE k = 1
  UNION ALL
  SELECT o.lang, o.chunk_id, o.path, o.idx, o.length, o.k, p.container_no + CASE WHEN p.filled >= {SEAL} THEN 1 ELSE 0 END,
         CASE WHEN p.filled >= {SEAL} THEN 0 ELSE p.filled END, CASE WHEN p.filled >= {SEAL} THEN 0 ELSE p.filled END + o.length
  FROM packed p JOIN o ON o.lang = p.lang AND o.k = p.k + 1)"""
LOCATORS_SQL = f"""{PACKED_SQL}, locators AS (SELECT lang AS region, chunk_id, sha256(lang || ':' || container_no) AS container, "offset", length, container_no FROM packed)"""


def chunks(spark, sf_dir):
    return C.chunks(files(spark, sf_dir), 1024)


def packed(spark, sf_dir):
    return P.seal(P.unique_chunks(chunks(spark, sf_dir), "lang"), "lang", SEAL)


def locators(spark, sf_dir):
    """region (a language), chunk_id, container, offset and length of every stored chunk."""
    return packed(spark, sf_dir).select(F.col("lang").alias("region"), "chunk_id", P.container_id("lang", F.col("container_no").cast("string")).alias("container"), "offset", "length", "container_no")


def containers(spark, sf_dir):
    """container and its bytes; a container is at most the seal size and one chunk."""
    data = C.split(files(spark, sf_dir), 1024).select("path", "idx", "data")
    parts = packed(spark, sf_dir).join(data, ["path", "idx"]).groupBy("lang", "container_no").agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("p"))
    return parts.select(P.container_id("lang", F.col("container_no").cast("string")).alias("container"), joined_bytes(F.col("p"), "data").alias("bytes"))


@query(f"""WITH {_CHUNKS} SELECT DISTINCT lang, chunk_id, length FROM chunks WHERE doc_id % 2 = 1
  AND (lang, chunk_id) NOT IN (SELECT lang, chunk_id FROM chunks WHERE doc_id % 2 = 0)""")
def new_chunks_only(spark, sf_dir):
    """What the odd files add to a store that holds the even ones."""
    every = chunks(spark, sf_dir)
    new = every.where("doc_id % 2 = 1").select("lang", "chunk_id", "length").distinct()
    return P.missing(new, every.where("doc_id % 2 = 0").select("lang", "chunk_id"), ["lang", "chunk_id"])


def _placed_sql(align: int) -> str:
    padded = f"((length + {align - 1}) // {align}) * {align}"
    return f"""WITH {_CHUNKS} SELECT path, idx, CAST(coalesce(sum({padded}) OVER (PARTITION BY dir ORDER BY path, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM chunks"""


@query(_placed_sql(1))
def pack_tight(spark, sf_dir):
    return P.place(chunks(spark, sf_dir), "dir").select("path", "idx", "offset")


@query(_placed_sql(512))
def pack_aligned(spark, sf_dir):
    return P.place(chunks(spark, sf_dir), "dir", 512).select("path", "idx", "offset")


@query(f"""WITH {_CHUNKS} SELECT dir, CAST(sum(length) AS BIGINT) AS tight, CAST(sum(((length + 4095) // 4096) * 4096) AS BIGINT) AS aligned,
  round(sum(((length + 4095) // 4096) * 4096) / sum(length), 6) AS inflation FROM chunks GROUP BY dir""")
def pack_padding_cost(spark, sf_dir):
    found = chunks(spark, sf_dir).groupBy("dir").agg(F.sum("length").alias("tight"), F.sum(P.aligned(F.col("length"), 4096)).alias("aligned"))
    return found.withColumn("inflation", F.round(F.col("aligned") / F.col("tight"), 6))


@query(f"""WITH RECURSIVE {PACKED_SQL} SELECT lang, path, idx, container_no, "offset" FROM packed""")
def pack_greedy_seal(spark, sf_dir):
    return packed(spark, sf_dir).select("lang", "path", "idx", "container_no", "offset")


@query(f"""WITH RECURSIVE {LOCATORS_SQL} SELECT region, chunk_id, 'c/' || region || '/' || substr(container, 1, 2) || '/' || container AS key, "offset", length FROM locators""")
def locator_keys(spark, sf_dir):
    return locators(spark, sf_dir).select("region", "chunk_id", P.container_key("region", "container").alias("key"), "offset", "length")


@query(f"""WITH {_CHUNKS}, f AS (SELECT path, size FROM files) SELECT path, idx, CASE WHEN size >= 16384 THEN sha256(path || ':' || idx) ELSE 'shared' END AS container
FROM chunks JOIN f USING (path)""")
def single_object_split(spark, sf_dir):
    """Chunks of large files get a container each."""
    every = files(spark, sf_dir)
    pieces = C.chunks(every.select("path", "size", "content"), 1024)
    return pieces.select("path", "idx", F.when(F.col("size") >= 16384, P.container_id("path", F.col("idx").cast("string"))).otherwise("shared").alias("container"))


@query(f"""WITH RECURSIVE {LOCATORS_SQL} SELECT chunk_id, region, substr(container, 1, 1) <> '0' AS ok FROM locators""")
def scrub(spark, sf_dir):
    """Reads every chunk back and checks its hash; in the containers whose id begins with 0 every bit is flipped on purpose."""
    flipped = F.unhex(F.translate(F.hex("bytes"), "0123456789ABCDEF", "FEDCBA9876543210"))
    damaged = F.when(F.col("container").startswith("0"), flipped).otherwise(F.col("bytes"))
    found = P.scrub(locators(spark, sf_dir), containers(spark, sf_dir).withColumn("bytes", damaged))
    return found.select("chunk_id", "region", "ok")


@query("""SELECT object, arg_max(value, (tm, seq)) AS value FROM (SELECT event_id AS seq, epoch_us(ts) AS tm, CAST(json_extract_string(props, '$.k') AS BIGINT) AS object, value FROM events) GROUP BY object""")
def locator_upsert(spark, sf_dir):
    from cairnstore.sources.views import mutations

    log = mutations(spark, sf_dir).select("object", "value", F.struct("at", "seq").alias("o"))
    return P.latest_locators(log, ["object"], "o").select("object", "value")


@query(f"WITH {_CHUNKS} SELECT path, name, size FROM files WHERE starts_with(path, '/en/src1') AND path > '/en/src1/' ORDER BY path LIMIT 20")
def list_prefix_page(spark, sf_dir):
    return N.page(files(spark, sf_dir).where(F.col("path").startswith("/en/src1")), "/en/src1/", 20, "path").select("path", "name", "size")


@query(f"WITH RECURSIVE {LOCATORS_SQL} SELECT count(DISTINCT container) AS containers, CAST(sum(length) AS BIGINT) AS bytes FROM locators")
def backend_usage(spark, sf_dir):
    each = locators(spark, sf_dir).groupBy("container").agg(F.sum("length").alias("size"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("bytes"))


@query(f"""WITH {_CHUNKS} SELECT chunk_id, max(length) AS length FROM chunks WHERE lang = 'en' AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE lang <> 'en') GROUP BY 1""")
def replication_diff(spark, sf_dir):
    """Specified: chunks of the English subtree that no other region holds."""
    every = chunks(spark, sf_dir)
    return R.difference(every.where("lang = 'en'"), every.where("lang <> 'en'").select("chunk_id").distinct())


@query(f"""WITH RECURSIVE {LOCATORS_SQL} SELECT DISTINCT container, sha256('7:' || container) AS order_key FROM locators""")
def shuffle_plan(spark, sf_dir):
    return R.shuffled(locators(spark, sf_dir).select("container").distinct(), 7)


@query(f"""WITH {_CHUNKS}, cached AS (SELECT DISTINCT chunk_id FROM chunks WHERE substr(chunk_id, 1, 1) < '8')
SELECT dir, count(c.chunk_id) AS held, count(*) AS chunks, round(count(c.chunk_id) / count(*), 6) AS coverage
FROM (SELECT DISTINCT dir, chunk_id FROM chunks) d LEFT JOIN cached c USING (chunk_id) GROUP BY dir""")
def coverage_score(spark, sf_dir):
    every = chunks(spark, sf_dir).select("dir", "chunk_id").distinct()
    return R.coverage(every, every.where(F.substring("chunk_id", 1, 1) < "8").select("chunk_id").distinct(), "dir")


@query(f"""WITH RECURSIVE {LOCATORS_SQL} SELECT region, CAST(row_number() OVER (PARTITION BY region ORDER BY chunk_id) AS BIGINT) AS place, chunk_id, container, "offset", length FROM locators""")
def list_locators(spark, sf_dir):
    """A region's locators in the order of their chunks' ids."""
    place = F.row_number().over(Window.partitionBy("region").orderBy("chunk_id")).cast("long")
    return locators(spark, sf_dir).select("region", place.alias("place"), "chunk_id", "container", "offset", "length")


@query(f"""WITH RECURSIVE {LOCATORS_SQL}, held AS (SELECT region, chunk_id, container FROM locators WHERE substr(chunk_id, 1, 1) <> '3')
SELECT path, idx, container, CASE WHEN container IS NULL THEN 'missing' ELSE 'ok' END AS verdict FROM chunks LEFT JOIN held ON region = lang AND held.chunk_id = chunks.chunk_id""")
def locate_report(spark, sf_dir):
    """Where each chunk of each file is read from; locators of a sixteenth of the chunks are gone, which is an error there."""
    held = locators(spark, sf_dir).where(F.substring("chunk_id", 1, 1) != "3").select(F.col("region").alias("lang"), "chunk_id", "container")
    return P.located(chunks(spark, sf_dir).select("lang", "path", "idx", "chunk_id"), held, ["lang", "chunk_id"]).select("path", "idx", "container", "verdict")


@query(f"""WITH {FILES_SQL}, p AS (SELECT path, dir, 0 AS idx, size AS length FROM files WHERE size BETWEEN 1 AND 4095
  UNION ALL SELECT path, dir, unnest(range((size + 1023) // 1024)) AS idx, CAST(least(1024, size - idx * 1024) AS BIGINT) FROM files WHERE size >= 4096)
SELECT path, CAST(idx AS BIGINT) AS idx, CAST(length AS BIGINT) AS length, CAST(coalesce(sum(length) OVER (PARTITION BY dir ORDER BY path, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM p""")
def packing_order(spark, sf_dir):
    """Specified: files in the order of their names, those below a size (4 KiB here) as one chunk each."""
    every = files(spark, sf_dir).select("path", "dir", "size", "content")
    small = every.where("size BETWEEN 1 AND 4095").select("path", "dir", F.lit(0).cast("long").alias("idx"), F.col("size").alias("length"))
    large = C.chunks(every.where("size >= 4096").drop("size"), 1024).select("path", "dir", "idx", "length")
    return P.place(small.unionByName(large), "dir").select("path", "idx", "length", "offset")
