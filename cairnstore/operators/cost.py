"""The cost model: estimates, budgets, attribution, choice of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GB = 1e9


def replication(objects: Column, bytes_: Column, egress_per_gb: Column, get_per_1k: Column) -> tuple[Column, Column]:
    """(egress USD, request USD) of copying once."""
    return bytes_ / GB * egress_per_gb, objects / 1000.0 * get_per_1k


def request_rate(nodes: Column, bytes_per_s: Column, chunk: Column) -> Column:
    return nodes * bytes_per_s / chunk


def steady_state(gets_per_s: Column, hit_rate: Column, get_per_1k: Column) -> tuple[Column, Column]:
    """(requests, USD) an hour; requests are cut to whole numbers."""
    requests = ((1 - hit_rate) * gets_per_s * 3600).cast("long")
    return requests, (1 - hit_rate) * gets_per_s * 3600 / 1000.0 * get_per_1k


def breaches(usd: Column, egress_gb: Column, request_usd: Column, max_usd: Column, max_gb: Column, max_requests: Column) -> Column:
    """What is over budget, joined by ``; ``; a budget of 0 has no bound, and being at it is allowed."""
    over = lambda x, most, name: F.when((most > 0) & (x > most), name)
    each = F.array(over(usd, max_usd, "budget"), over(egress_gb, max_gb, "egress"), over(request_usd, max_requests, "requests"))
    return F.array_join(F.filter(each, lambda x: x.isNotNull()), "; ")


def admit(breached: Column, on_exceed: Column) -> Column:
    """An alert lets a breach through; any other policy, known or not, refuses it."""
    return (breached == "") | (on_exceed == "alert")


def totals(observations: DataFrame, keys: list[str]) -> DataFrame:
    return observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("usd").alias("usd"))


#: Rank and USD per GB of each kind of source.
SOURCES = (("peer-same-az", 1, 0.0), ("origin-same-region", 2, 0.0), ("peer-cross-az", 3, 0.02), ("origin-cross-region", 4, 0.09))


def cheapest(candidates: DataFrame, key: str) -> DataFrame:
    """The best-ranked source of each key."""
    return candidates.groupBy(key).agg(F.min_by("source", "rank").alias("source"), F.min("rank").alias("rank"))


def placement(used: DataFrame, per_gb: float, per_1k: float) -> DataFrame:
    """Specified: the estimate of a policy for ``used`` (bytes, objects, copies, share): the first copies once, and the share that changes in each month."""
    once, again = F.col("copies") - 1, F.col("copies") * F.col("share")
    usd = lambda times: F.col("bytes") * times / F.lit(1e9) * per_gb + F.col("objects") * times / F.lit(1000.0) * per_1k
    return used.withColumns({"bytes_moved": F.col("bytes") * once, "one_time_usd": usd(once), "monthly_usd": usd(again)})
