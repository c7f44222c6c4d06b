"""Replication, placement and shuffle plans; most are specified in the reference, not in its code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def difference(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Chunks to send: reachable ones that the destination has no locator for."""
    return wanted.select("chunk_id", "length").distinct().join(present, "chunk_id", "left_anti")


def shuffled(containers: DataFrame, seed: int) -> DataFrame:
    """Adds the sort key of an epoch's order, the same wherever it is computed."""
    return containers.withColumn("order_key", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("container")), 256))


def coverage(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Share of each data set's chunks that a node holds."""
    found = wanted.join(cached.withColumn("_held", F.lit(1)), "chunk_id", "left")
    return found.groupBy(key).agg(F.count("_held").alias("held"), F.count(F.lit(1)).alias("chunks"), F.round(F.count("_held") / F.count(F.lit(1)), 6).alias("coverage"))


def home_regions(paths: DataFrame, homes: DataFrame) -> DataFrame:
    """The home of the longest prefix of each path.  Each path is joined once per ancestor, by equality."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    each = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))
    found = paths.select("path", F.explode(each).alias("prefix")).join(homes, "prefix")
    return found.groupBy("path").agg(F.max_by("home", F.length("prefix")).alias("home"))


def boundary(src_class: Column, dst_class: Column, src_region: Column, dst_region: Column) -> Column:
    """Whether a rename may cross: not into or out of immutable, nor between regions or classes."""
    return (
        F.when(dst_class == "immutable", "EROFS").when(src_class == "immutable", "EROFS")
        .when((src_region != dst_region) | (src_class != dst_class), "EXDEV").otherwise("ok")
    )


def access_mode(mode: Column, storage_class: Column) -> Column:
    """Whether a volume may be mounted: many writers only with a class that has a contract for them."""
    return F.when(mode.isin("ROX", "RWO"), F.when((mode == "RWO") & (storage_class == "immutable"), "refused").otherwise("ok")).when(
        (mode == "RWX") & storage_class.isin("posix"), "ok").when((mode == "RWX") & (storage_class == "relaxed"), "disjoint-writers").otherwise("refused")
