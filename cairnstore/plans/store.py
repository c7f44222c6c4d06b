"""Queries over the object store, ingest, locators over time, container rewrites and repeated sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.operators import gc as G
from cairnstore.operators import namespace as N
from cairnstore.operators import packing as P
from cairnstore.operators import store as S
from cairnstore.plans.garbage import _GRAVE, _LIVENESS, _graveyard, _objects, _pinned
from cairnstore.plans.packing import LOCATORS_SQL, SEAL, chunks, containers, locators, packed
from cairnstore.plans.registry import registry
from cairnstore.sources.views import FILES_SQL, MUTATIONS_SQL, chunks_sql, files, mutations, table

QUERIES, SQL, query = registry()


def _keyed(spark, sf_dir):
    """Files as objects: every tenth is asked for by a key that isn't there."""
    return files(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 10 == 9, F.concat("path", F.lit("?"))).otherwise(F.col("path")).alias("key"))


@query(f"""WITH {FILES_SQL} SELECT CASE WHEN doc_id % 10 = 9 THEN path || '?' ELSE path END AS key, CASE WHEN doc_id % 10 <> 9 THEN size END AS size, CASE WHEN doc_id % 10 = 9 THEN 'ENOENT' ELSE 'ok' END AS verdict FROM files""")
def object_stat(spark, sf_dir):
    return S.stat(_keyed(spark, sf_dir).select("key"), files(spark, sf_dir).select(F.col("path").alias("key"), "size"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 10 <> 9 THEN sha256(CASE WHEN doc_id % 4 = 0 THEN content[doc_id % 300 + 1:] ELSE content[doc_id % 300 + 1:doc_id % 300 + 500] END) END AS hash,
  CASE WHEN doc_id % 10 = 9 THEN 'ENOENT' ELSE 'ok' END AS verdict FROM files""")
def object_get(spark, sf_dir):
    """500 bytes of each object, or all to its end, from somewhere in its first 300 on."""
    asked = _keyed(spark, sf_dir).select("doc_id", "key", (F.col("doc_id") % 300).alias("off"), F.when(F.col("doc_id") % 4 == 0, -1).otherwise(500).alias("n"))
    return S.get(asked, files(spark, sf_dir).select(F.col("path").alias("key"), "content")).select("doc_id", F.sha2("bytes", 256).alias("hash"), "verdict")


@query(f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN n = 0 THEN 'noop' WHEN doc_id % 10 = 9 THEN 'ENOENT' WHEN size < n THEN 'short' ELSE 'ok' END AS verdict, doc_id * 512 % 4096 = 0 AND n % 4096 = 0 AS aligned
FROM (SELECT *, doc_id % 7 * 1024 AS n FROM files)""")
def get_into(spark, sf_dir):
    """Buffers of up to 6 KiB filled from the objects' beginnings, and whether offset and length are aligned."""
    asked = _keyed(spark, sf_dir).withColumn("n", F.col("doc_id") % 7 * 1024)
    found = S.stat(asked, files(spark, sf_dir).select(F.col("path").alias("key"), "size"))
    return found.select("doc_id", S.get_into(F.col("n"), F.col("size")).alias("verdict"), S.is_aligned(F.col("doc_id") * 512, F.col("n"), F.lit(0), F.lit(8192)).alias("aligned"))


_PUTS = f"""{FILES_SQL}, r AS (SELECT doc_id AS seq, '/obj/' || (doc_id * 7 % 400) AS key, doc_id % 3 <> 0 AS if_absent FROM files), held AS (SELECT DISTINCT '/obj/' || (doc_id % 100) AS key FROM files)"""


def _puts(spark, sf_dir):
    every = files(spark, sf_dir)
    asked = every.select(F.col("doc_id").alias("seq"), F.concat(F.lit("/obj/"), F.col("doc_id") * 7 % 400).alias("key"), (F.col("doc_id") % 3 != 0).alias("if_absent"))
    return asked, every.select(F.concat(F.lit("/obj/"), F.col("doc_id") % 100).alias("key")).distinct()


@query(f"""WITH {_PUTS} SELECT seq, key, CASE WHEN NOT there THEN 'created' WHEN if_absent THEN 'EEXIST' ELSE 'replaced' END AS verdict
FROM (SELECT *, key IN (SELECT key FROM held) OR EXISTS (SELECT 1 FROM r o WHERE o.key = r.key AND o.seq < r.seq) AS there FROM r)""")
def put_objects(spark, sf_dir):
    """Blind and create-only puts in order."""
    return S.put(*_puts(spark, sf_dir)).select("seq", "key", "verdict")


@query(f"""WITH {_PUTS} SELECT seq AS place, key, key IN (SELECT key FROM held) AND seq = min(seq) OVER (PARTITION BY key) AS deleted, 'ok' AS verdict FROM r""")
def delete_objects(spark, sf_dir):
    """Results by place in the request; absent is success."""
    asked, held = _puts(spark, sf_dir)
    return S.delete(asked.select("key", F.col("seq").alias("place")), held).select("place", "key", "deleted", "verdict")


@query("""SELECT * FROM (VALUES ('local', true, false, CAST(0 AS BIGINT), '', CAST(1099511627776 AS BIGINT), CAST(1 AS BIGINT)), ('s3', true, false, 0, 'STANDARD,STANDARD_IA,GLACIER', 0, 1),
  ('gcs', true, false, 0, 'STANDARD,NEARLINE,COLDLINE,ARCHIVE', 0, 1), ('azure', true, false, 0, 'Hot,Cool,Cold,Archive', 0, 1)) t(backend, conditional_put, multipart, batch_delete, tiers, max_object, reap_batch)""")
def backend_capabilities(spark, sf_dir):
    return S.capabilities(spark).withColumn("tiers", F.array_join("tiers", ",")).withColumn("reap_batch", F.greatest(F.lit(1).cast("long"), "batch_delete"))


@query(f"""WITH {FILES_SQL}, k AS (SELECT CASE WHEN doc_id % 13 = 0 THEN 'fifo' WHEN doc_id % 11 = 0 THEN 'link' ELSE 'file' END AS kind, size, dir, lang FROM files)
SELECT (SELECT count(*) FROM k WHERE kind <> 'fifo') AS files, (SELECT count(DISTINCT dir) + count(DISTINCT lang) FROM k) AS dirs, (SELECT CAST(sum(size) AS BIGINT) FROM k WHERE kind = 'file') AS bytes""")
def publish_tree_totals(spark, sf_dir):
    """The documents as a source tree in which some entries are links and some are neither."""
    every = files(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 13 == 0, "fifo").when(F.col("doc_id") % 11 == 0, "link").otherwise("file")
    folders = N.directories(every).where("depth > 0").select(F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"))
    return S.ingest_totals(every.select(kind.alias("kind"), "size").unionByName(folders))


_LOG = f"""{MUTATIONS_SQL}, l AS (SELECT seq, tm, CAST(holder % 3 AS VARCHAR) AS region, CAST(object AS VARCHAR) AS chunk_id, 'c' || (seq % 97) AS container, CASE WHEN op = 'unlink' THEN 'delete' ELSE 'put' END AS op FROM mutations)"""


def _locator_log(spark, sf_dir):
    """The events as puts and deletes of locators."""
    log = mutations(spark, sf_dir)
    op = F.when(F.col("op") == "unlink", "delete").otherwise("put")
    return log.select("seq", "at", (F.col("holder") % 3).cast("string").alias("region"), F.col("object").cast("string").alias("chunk_id"), F.concat(F.lit("c"), F.col("seq") % 97).alias("container"), op.alias("op"))


@query(f"WITH {_LOG} SELECT region, chunk_id, container FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY region, chunk_id ORDER BY tm DESC, seq DESC) = 1) WHERE op = 'put'")
def locator_log_state(spark, sf_dir):
    """Locators after puts and deletes; deleting what isn't there changes nothing."""
    return S.locator_state(_locator_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT container, min(tm) AS sealed_at, count(*) AS puts FROM l WHERE op = 'put' GROUP BY container")
def container_first_mention(spark, sf_dir):
    return S.first_mentions(_locator_log(spark, sf_dir))


_PENDING = f"""{LOCATORS_SQL}, pending AS (SELECT lang, chunk_id FROM packed JOIN (SELECT lang, max(container_no) AS container_no FROM packed GROUP BY lang) e USING (lang, container_no)
  JOIN (SELECT lang, container_no, max("offset" + length) AS f FROM packed GROUP BY ALL) USING (lang, container_no) WHERE f < {SEAL})"""


@query(f"WITH RECURSIVE {_PENDING} SELECT lang, chunk_id FROM pending")
def pending_chunks(spark, sf_dir):
    """Chunks that are buffered but in no sealed container."""
    return S.pending(packed(spark, sf_dir), "lang", SEAL).select("lang", "chunk_id")


@query(f"""WITH RECURSIVE {_PENDING}, {_GRAVE}, marked AS (SELECT path FROM files WHERE dir <> '/en/src1' AND doc_id NOT IN (SELECT inode FROM graveyard)
  UNION SELECT path FROM files WHERE doc_id IN (SELECT inode FROM graveyard) AND doc_id NOT IN (SELECT inode FROM expired))
SELECT chunk_id FROM chunks WHERE path IN (SELECT path FROM marked) UNION SELECT chunk_id FROM pending""")
def gc_mark_from_root(spark, sf_dir):
    """Live chunks: of files that the root reaches (one directory is detached), of unlinked ones not due or held open, and pending ones."""
    every = files(spark, sf_dir)
    lost = spark.createDataFrame([("/en/src1",)], "ancestor string")
    reached = S.reachable_files(N.ancestors(every).select("path", "ancestor"), lost)
    grave, pinned = _graveyard(spark, sf_dir), _pinned(spark, sf_dir)
    inodes = every.select("path", F.col("doc_id").alias("inode"))
    bound = inodes.join(reached, "path").join(grave, "inode", "left_anti")
    kept = inodes.join(grave.where(F.col("deleted_at") > 500_000).select("inode").unionByName(grave.join(pinned, "inode", "left_semi").select("inode")).distinct(), "inode")
    held = chunks(spark, sf_dir).select("path", "chunk_id").join(bound.select("path").unionByName(kept.select("path")), "path", "left_semi").select("chunk_id")
    return held.unionByName(S.pending(packed(spark, sf_dir), "lang", SEAL).select("chunk_id")).distinct()


@query(f"""WITH RECURSIVE {LOCATORS_SQL}, {_GRAVE}, {_LIVENESS}, plan AS (SELECT container FROM l WHERE share < 0.5 AND live > 0 AND container NOT IN (SELECT container FROM dead)),
q AS (SELECT p.lang, p.path, p.idx, p.chunk_id, p.length, row_number() OVER (PARTITION BY p.lang ORDER BY p.path, p.idx) AS k FROM packed p JOIN locators c ON c.region = p.lang AND c.chunk_id = p.chunk_id
  WHERE c.container IN (SELECT container FROM plan) AND substr(p.chunk_id, 1, 1) < '7'),
w AS (SELECT lang, chunk_id, k, CAST(0 AS BIGINT) AS container_no, CAST(0 AS BIGINT) AS "offset", length AS filled FROM q WHERE k = 1
  UNION ALL SELECT q.lang, q.chunk_id, q.k, w.container_no + CASE WHEN w.filled >= {SEAL} THEN 1 ELSE 0 END, CASE WHEN w.filled >= {SEAL} THEN 0 ELSE w.filled END, CASE WHEN w.filled >= {SEAL} THEN 0 ELSE w.filled END + q.length
  FROM w JOIN q ON q.lang = w.lang AND q.k = w.k + 1)
SELECT lang AS region, chunk_id, sha256('rewritten:' || lang || ':' || container_no) AS container, "offset", true AS verified FROM w""")
def gc_rewrite(spark, sf_dir):
    """New locators of the live chunks in containers that are less than half live: read back and checked, packed anew; nothing for a container without any."""
    sizes, live = _objects(spark, sf_dir)
    dead = locators(spark, sf_dir).where(F.substring("container", 1, 1) < "4").select("container").distinct()
    plan = G.compact(sizes, live, dead).select("container")
    checked = P.scrub(live.join(plan, "container", "left_semi"), containers(spark, sf_dir)).select("region", "chunk_id", "ok")
    rows = packed(spark, sf_dir).select(F.col("lang").alias("region"), "path", "idx", "chunk_id", "length").join(checked, ["region", "chunk_id"])
    new = P.seal(rows, "region", SEAL)
    return new.select("region", "chunk_id", P.container_id(F.concat(F.lit("rewritten:"), "region"), F.col("container_no").cast("string")).alias("container"), "offset", F.col("ok").alias("verified"))


@query("""SELECT doc_id AS inode, CAST(ceil((doc_id * 1000 + 3600) / 100000.0) AS BIGINT) AS tick FROM documents WHERE doc_id % 10 IN (3, 7) AND doc_id % 70 <> 7""")
def gc_sweep_ticks(spark, sf_dir):
    """A sweep on a ticker: which tick drops which unlinked inode."""
    return S.sweep_ticks(_graveyard(spark, sf_dir), _pinned(spark, sf_dir), 100_000, 3600)
