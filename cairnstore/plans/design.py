"""Queries over what the reference specifies without code: models, snapshots, fences, revalidation, chunking ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.operators import chunking
from cairnstore.operators import coherence as H
from cairnstore.operators import content as C
from cairnstore.operators import gc as G
from cairnstore.operators import models
from cairnstore.plans.garbage import _CUT, _GRAVE, _graveyard, _pieces, _pinned
from cairnstore.plans.packing import LOCATORS_SQL
from cairnstore.plans.registry import registry
from cairnstore.sources.views import MUTATIONS_SQL, files, mutations, table

QUERIES, SQL, query = registry()
_DAY = 24 * G.HOUR


@query("""WITH RECURSIVE s AS (
  SELECT 1 AS epoch, 0 AS home, false AS sealing, false AS drained, false AS copied, 0 AS homes, CAST(0 AS BIGINT) AS accepted
  UNION SELECT CASE WHEN a = 3 THEN epoch + 1 ELSE epoch END, CASE WHEN a = 3 THEN 1 - home ELSE home END,
    CASE a WHEN 0 THEN true WHEN 3 THEN false ELSE sealing END, CASE a WHEN 1 THEN true WHEN 3 THEN false ELSE drained END,
    CASE a WHEN 2 THEN true WHEN 3 THEN false ELSE copied END, CASE WHEN a = 3 THEN homes | ((1 - home) << epoch) ELSE homes END,
    CASE WHEN a > 3 THEN accepted | (CAST(1 AS BIGINT) << (((epoch - 1) * 2 + a - 4) * 4 + home * 2)) ELSE accepted END
  FROM s, (VALUES (0), (1), (2), (3), (4), (5)) t(a)
  WHERE (a = 0 AND NOT sealing AND epoch < 3) OR (a = 1 AND sealing AND NOT drained) OR (a = 2 AND sealing AND drained AND NOT copied)
    OR (a = 3 AND sealing AND drained AND copied) OR (a > 3 AND NOT sealing))
SELECT epoch, home, sealing, drained, copied, homes, accepted, true AS safe FROM s""")
def rehoming_states(spark, sf_dir):
    """Two clients and three epochs; no state may be unsafe."""
    return models.rehoming_states(spark)


@query(f"""WITH RECURSIVE {LOCATORS_SQL}, {_GRAVE} SELECT DISTINCT chunk_id FROM chunks
WHERE doc_id NOT IN (SELECT inode FROM expired) OR doc_id % 20 = 3""")
def snapshot_live_chunks(spark, sf_dir):
    """A snapshot of the inodes whose id leaves 3 by 20 is another root: what it holds outlives the names."""
    held = files(spark, sf_dir).where("doc_id % 20 = 3").select(F.col("doc_id").alias("inode"))
    return G.live_with_snapshots(_pieces(spark, sf_dir), _graveyard(spark, sf_dir), _pinned(spark, sf_dir), _CUT, held)


@query(f"""SELECT o_orderkey AS commit_id, count(*) AS refs, count(*) FILTER (WHERE epoch_us(o_orderdate) + {60 * _DAY} - epoch_us(l_shipdate) > {30 * _DAY}) AS stale_refs,
  CASE WHEN count(*) FILTER (WHERE epoch_us(o_orderdate) + {60 * _DAY} - epoch_us(l_shipdate) > {30 * _DAY}) > 0 THEN 'ESTALE' ELSE 'ok' END AS verdict
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def upload_fence(spark, sf_dir):
    """Orders as commits of 60 days later, line items as the chunks that they refer to, a write of at most 30 days."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), (micros("o_orderdate") + 60 * _DAY).alias("at"))
    uploads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), micros("l_shipdate").alias("uploaded_at"))
    return G.fence(commits, uploads, 30 * _DAY)


@query(f"""WITH {MUTATIONS_SQL}, v AS (SELECT *, sum(CASE WHEN op IN ('commit', 'create', 'unlink') THEN 1 ELSE 0 END) OVER (PARTITION BY object ORDER BY tm, seq) AS version FROM mutations),
now AS (SELECT object, max(version) AS version FROM v GROUP BY object), dirs AS (SELECT object % 25 AS dir, sum(version) AS dirver FROM now GROUP BY 1),
seen AS (SELECT holder, object, max(version) AS seen FROM v WHERE op = 'lookup' GROUP BY ALL)
SELECT holder, object % 25 AS dir, CAST(dirver AS BIGINT) AS dirver, coalesce(string_agg(CAST(object AS VARCHAR), ',' ORDER BY object) FILTER (WHERE seen < version), '') AS stale
FROM seen JOIN now USING (object) JOIN dirs ON dir = object % 25 GROUP BY holder, object % 25, dirver""")
def batched_revalidation(spark, sf_dir):
    """One request per holder and directory: its version, and the holder's inodes that have changed since they were looked up."""
    found = H.revalidate(mutations(spark, sf_dir), 25)
    return found.withColumn("stale", F.array_join(F.transform("stale", lambda x: x.cast("string")), ","))


@query()
def dedup_analyze(spark, sf_dir):
    """Ratios by whole files, fixed blocks and content-defined chunks, and whether the last pay.  Tested against brute force."""
    every = files(spark, sf_dir)
    kinds = [("whole", every.select(C.chunk_id("content").alias("chunk_id"), F.col("size").alias("length"))), ("fixed", C.chunks(every, 1024)), ("content-defined", chunking.content_defined(every))]
    out = None
    for kind, pieces in kinds:
        row = chunking.ratio(pieces).select(F.lit(kind).alias("kind"), "*")
        out = row if out is None else out.unionByName(row)
    return out
