"""Queries over costs and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.operators import cost as M
from cairnstore.plans.registry import registry
from cairnstore.sources.views import EGRESS_SQL, FILES_SQL, egress, files, table

QUERIES, SQL, query = registry()


@query("""SELECT p_partkey, round(b / 1e9 * 0.09, 6) AS egress_usd, round(o / 1000.0 * 0.0004, 6) AS request_usd, round(b / 1e9 * 0.09 + o / 1000.0 * 0.0004, 6) AS total_usd
FROM (SELECT p_partkey, p_partkey * 1000000007 AS b, p_partkey * 997 AS o FROM part)""")
def replication_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 1000000007).alias("b"), (F.col("p_partkey") * 997).alias("o"))
    move, ask = M.replication(F.col("o"), F.col("b"), F.lit(0.09), F.lit(0.0004))
    return rows.select("p_partkey", F.round(move, 6).alias("egress_usd"), F.round(ask, 6).alias("request_usd"), F.round(move + ask, 6).alias("total_usd"))


@query("""SELECT p_partkey, round(n * 5e9 / 4194304, 4) AS gets_per_s, CAST(trunc((1 - h) * (n * 5e9 / 4194304) * 3600) AS BIGINT) AS requests_per_h, round((1 - h) * (n * 5e9 / 4194304) * 3600 / 1000.0 * 0.0004, 4) AS usd_per_h
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, (p_partkey % 4) * 0.25 AS h FROM (SELECT * FROM part))""")
def steady_state_cost(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("n"), ((F.col("p_partkey") % 4) * 0.25).alias("h"))
    rate = M.request_rate(F.col("n"), F.lit(5e9), F.lit(4194304))
    requests, usd = M.steady_state(rate, F.col("h"), F.lit(0.0004))
    return rows.select("p_partkey", F.round(rate, 4).alias("gets_per_s"), requests.alias("requests_per_h"), F.round(usd, 4).alias("usd_per_h"))


@query("""SELECT p_partkey, reason, reason = '' OR policy = 'alert' AS allowed FROM (SELECT p_partkey, policy, array_to_string(list_filter([CASE WHEN lim > 0 AND usd > lim THEN 'budget' END,
  CASE WHEN gb > 20 THEN 'egress' END, CASE WHEN req > 1 THEN 'requests' END], lambda x: x IS NOT NULL), '; ') AS reason
FROM (SELECT p_partkey, p_retailprice AS usd, CAST(p_size AS DOUBLE) AS gb, (p_partkey % 3) * 1.0 AS req, CASE WHEN p_partkey % 2 = 0 THEN 1200.0 ELSE 0.0 END AS lim,
  CASE p_partkey % 4 WHEN 0 THEN 'alert' WHEN 1 THEN 'degrade' WHEN 2 THEN 'block' ELSE 'other' END AS policy FROM part))""")
def budget_admission(spark, sf_dir):
    key = F.col("p_partkey")
    why = M.breaches(F.col("p_retailprice"), F.col("p_size").cast("double"), (key % 3) * 1.0, F.when(key % 2 == 0, 1200.0).otherwise(0.0), F.lit(20.0), F.lit(1.0))
    policy = F.when(key % 4 == 0, "alert").when(key % 4 == 1, "degrade").when(key % 4 == 2, "block").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", why.alias("reason"), M.admit(why, policy).alias("allowed"))


@query(f"WITH {EGRESS_SQL} SELECT src_region, dst_region, count(*) AS n, round(sum(usd), 2) AS usd FROM egress GROUP BY ALL")
def egress_totals(spark, sf_dir):
    return M.totals(egress(spark, sf_dir), ["src_region", "dst_region"]).withColumn("usd", F.round("usd", 2))


@query(f"WITH {EGRESS_SQL} SELECT subtree, round(sum(usd), 2) AS usd FROM (SELECT subtree, usd FROM egress UNION ALL SELECT subtree, quantity * 0.0004 FROM egress) GROUP BY subtree")
def subtree_total_usd(spark, sf_dir):
    seen = egress(spark, sf_dir)
    every = seen.select("subtree", "usd").unionByName(seen.select("subtree", (F.col("quantity") * 0.0004).alias("usd")))
    return M.totals(every, ["subtree"]).select("subtree", F.round("usd", 2).alias("usd"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'peer-same-az' WHEN p_partkey % 3 = 0 THEN 'origin-same-region' WHEN p_partkey % 5 = 0 THEN 'peer-cross-az' ELSE 'origin-cross-region' END AS source,
  CASE WHEN p_partkey % 2 = 0 THEN 1 WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 5 = 0 THEN 3 ELSE 4 END AS rank FROM part""")
def source_choice(spark, sf_dir):
    """Specified: the nearest of the sources that hold a chunk."""
    key = F.col("p_partkey")
    held = [F.when(key % n == 0, F.struct(F.lit(name).alias("source"), F.lit(rank).alias("rank"))) for n, (name, rank, _) in zip((2, 3, 5, 1), M.SOURCES)]
    each = table(spark, sf_dir, "part").select("p_partkey", F.inline(F.filter(F.array(*held), lambda x: x.isNotNull())))
    return M.cheapest(each, "p_partkey")


_POLICY = "(VALUES ('en', 3, 0.02), ('de', 2, 0.02), ('fr', 1, 0.01)) p(lang, copies, share)"


@query(f"""WITH {FILES_SQL}, u AS (SELECT lang, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS objects FROM files GROUP BY lang)
SELECT lang, bytes * (copies - 1) AS bytes_moved, round(bytes * (copies - 1) / 1e9 * 0.09 + objects * (copies - 1) / 1000.0 * 0.0004, 9) AS one_time_usd,
  round(bytes * copies * share / 1e9 * 0.09 + objects * copies * share / 1000.0 * 0.0004, 9) AS monthly_usd FROM u JOIN {_POLICY} USING (lang)""")
def placement_estimate(spark, sf_dir):
    """Specified: what a policy (copies of a subtree, and the share of it that changes in a month) will cost, before it runs."""
    policy = spark.createDataFrame([("en", 3, 0.02), ("de", 2, 0.02), ("fr", 1, 0.01)], "lang string, copies int, share double")
    used = files(spark, sf_dir).groupBy("lang").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("objects"))
    return M.placement(used.join(F.broadcast(policy), "lang"), 0.09, 0.0004).select("lang", "bytes_moved", F.round("one_time_usd", 9).alias("one_time_usd"), F.round("monthly_usd", 9).alias("monthly_usd"))
