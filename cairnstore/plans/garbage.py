"""Queries over garbage collection: documents whose id ends in 3 or 7 are unlinked, some are held open."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.operators import gc as G
from cairnstore.plans.packing import LOCATORS_SQL, chunks, locators
from cairnstore.plans.registry import registry
from cairnstore.sources.views import MUTATIONS_SQL, files, mutations, table

QUERIES, SQL, query = registry()
_CUT = 500_000
_GRAVE = f"""graveyard AS (SELECT doc_id AS inode, doc_id * 1000 AS deleted_at FROM documents WHERE doc_id % 10 IN (3, 7)),
pinned AS (SELECT doc_id AS inode FROM documents WHERE doc_id % 70 = 7),
expired AS (SELECT inode FROM graveyard WHERE deleted_at <= {_CUT} AND inode NOT IN (SELECT inode FROM pinned)),
live AS (SELECT DISTINCT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT inode FROM expired)),
dead AS (SELECT container, retired_at FROM (SELECT DISTINCT container, container_no * 1000 AS retired_at FROM locators) WHERE substr(container, 1, 1) < '4')"""
_WITH = f"WITH RECURSIVE {LOCATORS_SQL}, {_GRAVE} "


def _graveyard(spark, sf_dir):
    return files(spark, sf_dir).where("doc_id % 10 IN (3, 7)").select(F.col("doc_id").alias("inode"), (F.col("doc_id") * 1000).alias("deleted_at"))


def _pinned(spark, sf_dir):
    return files(spark, sf_dir).where("doc_id % 70 = 7").select(F.col("doc_id").alias("inode"))


def _pieces(spark, sf_dir):
    return chunks(spark, sf_dir).select(F.col("doc_id").alias("inode"), "chunk_id")


def _live(spark, sf_dir):
    return G.live_chunks(_pieces(spark, sf_dir), _graveyard(spark, sf_dir), _pinned(spark, sf_dir), _CUT)


def _sealed(spark, sf_dir):
    """container and sealed_at; every fifth container's age is unknown."""
    each = locators(spark, sf_dir).select("container", "container_no").distinct()
    return each.select("container", F.when(F.col("container_no") % 5 != 0, F.col("container_no") * 1000).alias("sealed_at"))


def _dead(spark, sf_dir):
    each = locators(spark, sf_dir).select("container", (F.col("container_no") * 1000).alias("retired_at")).distinct()
    return each.where(F.substring("container", 1, 1) < "4")


@query(_WITH + "SELECT inode, deleted_at FROM graveyard")
def graveyard(spark, sf_dir):
    return _graveyard(spark, sf_dir)


@query(_WITH + "SELECT chunk_id FROM live")
def gc_live_chunks(spark, sf_dir):
    return _live(spark, sf_dir)


@query(_WITH + "SELECT DISTINCT chunk_id FROM chunks WHERE doc_id IN (SELECT inode FROM expired) AND chunk_id NOT IN (SELECT chunk_id FROM live)")
def gc_sweep_plan(spark, sf_dir):
    return G.sweep(_pieces(spark, sf_dir), _graveyard(spark, sf_dir), _pinned(spark, sf_dir), _CUT)


@query(_WITH + """SELECT region, chunk_id, container FROM locators WHERE chunk_id NOT IN (SELECT chunk_id FROM live) AND container_no % 5 <> 0 AND container_no * 1000 <= 2000""")
def gc_orphans(spark, sf_dir):
    return G.orphans(locators(spark, sf_dir), _live(spark, sf_dir), _sealed(spark, sf_dir), 2000).select("region", "chunk_id", "container")


_LIVENESS = """objects AS (SELECT container, CAST(sum(length) AS BIGINT) AS size FROM locators GROUP BY 1),
kept AS (SELECT container, CAST(sum(length) AS BIGINT) AS live FROM locators WHERE substr(chunk_id, 1, 1) < '7' GROUP BY 1),
l AS (SELECT container, size, coalesce(live, 0) AS live, coalesce(live, 0) / size AS share FROM objects LEFT JOIN kept USING (container))"""


def _objects(spark, sf_dir):
    every = locators(spark, sf_dir)
    return every.groupBy("container").agg(F.sum("length").alias("size")), every.where(F.substring("chunk_id", 1, 1) < "7")


@query(_WITH + f", {_LIVENESS} SELECT container, size, live, round(share, 9) AS share FROM l")
def container_liveness(spark, sf_dir):
    return G.liveness(*_objects(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(_WITH + f", {_LIVENESS} SELECT container, size, live FROM l WHERE share < 0.5 AND container NOT IN (SELECT container FROM dead)")
def gc_compact_plan(spark, sf_dir):
    return G.compact(*_objects(spark, sf_dir), _dead(spark, sf_dir).select("container")).select("container", "size", "live")


@query(_WITH + """SELECT container, retired_at, CAST((row_number() OVER (ORDER BY container) - 1) // 3 AS BIGINT) AS batch FROM dead WHERE retired_at <= 8000""")
def gc_reap_batches(spark, sf_dir):
    return G.reap(_dead(spark, sf_dir), 8000, 3)


@query(f"""WITH {MUTATIONS_SQL}, h AS (SELECT object AS inode, holder AS handle, count(*) FILTER (WHERE op = 'grant') AS a, max(CASE WHEN op = 'unlink' THEN 1 ELSE 0 END) AS r
  FROM mutations WHERE op IN ('grant', 'unlink') GROUP BY ALL) SELECT inode, CAST(sum(CASE WHEN a > 0 THEN 1 - r ELSE 0 END) AS BIGINT) AS open FROM h GROUP BY inode HAVING open > 0""")
def open_pins(spark, sf_dir):
    log = mutations(spark, sf_dir).where("op IN ('grant', 'unlink')")
    return G.pins(log.select(F.col("object").alias("inode"), F.col("holder").alias("handle"), F.when(F.col("op") == "grant", "acquire").otherwise("release").alias("op")))


@query("""SELECT p_partkey, CASE WHEN p_partkey * 10000000 > 3630500000 THEN 'ok' ELSE 'refused' END AS verdict FROM part""")
def gc_grace_check(spark, sf_dir):
    """Grace periods in steps of ten seconds: at least one must be longer than a write, a lease and the clocks' error together."""
    return table(spark, sf_dir, "part").select("p_partkey", G.grace_verdict(F.col("p_partkey") * 10_000_000).alias("verdict"))
