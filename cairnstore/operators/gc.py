"""Mark, sweep, compact and reap, as plans: each returns the rows that it would act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOUR, SECOND = 3_600_000_000, 1_000_000
#: Microseconds: the longest write, lease and clock error that a sweep must outwait.
T_WRITE_MAX, D_MAX, EPSILON, GRACE = HOUR, 30 * SECOND, SECOND // 2, 24 * HOUR
LIVENESS = 0.5


def check_grace(grace: int) -> None:
    """The grace period must be longer than a write, a lease and the clocks' error together."""
    if grace <= T_WRITE_MAX + D_MAX + EPSILON:
        raise ValueError("grace period too short: a write in flight could lose its chunks")


def grace_verdict(grace: Column) -> Column:
    return F.when(grace > T_WRITE_MAX + D_MAX + EPSILON, "ok").otherwise("refused")


def pins(handles: DataFrame) -> DataFrame:
    """Inodes with more opened than released handles; a handle's release counts once."""
    per_handle = handles.groupBy("inode", "handle").agg(F.count_if(F.col("op") == "acquire").alias("a"), F.max((F.col("op") == "release").cast("int")).alias("r"))
    return per_handle.groupBy("inode").agg(F.sum(F.when(F.col("a") > 0, 1 - F.col("r")).otherwise(0)).alias("open")).where("open > 0")


def live_chunks(pieces: DataFrame, graveyard: DataFrame, pinned: DataFrame, cutoff: int) -> DataFrame:
    """Chunks of inodes that are bound, or unlinked after ``cutoff``, or held open."""
    expired = graveyard.where(F.col("deleted_at") <= cutoff).join(pinned, "inode", "left_anti").select("inode")
    return pieces.join(expired, "inode", "left_anti").select("chunk_id").distinct()


def live_with_snapshots(pieces: DataFrame, graveyard: DataFrame, pinned: DataFrame, cutoff: int, snapshots: DataFrame) -> DataFrame:
    """Specified: a snapshot's inodes are roots too, so that their chunks stay live without copying a byte."""
    kept = pieces.join(snapshots.select("inode"), "inode", "left_semi").select("chunk_id")
    return live_chunks(pieces, graveyard, pinned, cutoff).unionByName(kept).distinct()


def fence(commits: DataFrame, uploads: DataFrame, limit: int = T_WRITE_MAX) -> DataFrame:
    """Specified: commits that refer to a chunk uploaded more than ``limit`` before are refused; the chunk may be swept."""
    found = commits.join(uploads, "commit_id")
    each = found.groupBy("commit_id").agg(F.count(F.lit(1)).alias("refs"), F.count_if(F.col("at") - F.col("uploaded_at") > limit).alias("stale_refs"))
    return each.withColumn("verdict", F.when(F.col("stale_refs") > 0, "ESTALE").otherwise("ok"))


def sweep(pieces: DataFrame, graveyard: DataFrame, pinned: DataFrame, cutoff: int, grace: int = GRACE) -> DataFrame:
    """Distinct chunks that only expired inodes hold."""
    check_grace(grace)
    expired = graveyard.where(F.col("deleted_at") <= cutoff).join(pinned, "inode", "left_anti")
    return pieces.join(expired.select("inode"), "inode", "left_semi").select("chunk_id").distinct().join(live_chunks(pieces, graveyard, pinned, cutoff), "chunk_id", "left_anti")


def orphans(locators: DataFrame, live: DataFrame, containers: DataFrame, cutoff: int) -> DataFrame:
    """Locators of dead chunks in containers known to be sealed at or before ``cutoff``; an unknown age is kept."""
    old = containers.where(F.col("sealed_at").isNotNull() & (F.col("sealed_at") <= cutoff)).select("container")
    return locators.join(live, "chunk_id", "left_anti").join(old, "container", "left_semi")


def liveness(objects: DataFrame, locators: DataFrame) -> DataFrame:
    """Live bytes and their share of each container; a container without locators has none."""
    live = locators.groupBy("container").agg(F.sum("length").alias("live"))
    return objects.where("size > 0").join(live, "container", "left").select("container", "size", F.coalesce("live", F.lit(0)).alias("live"), (F.coalesce("live", F.lit(0)) / F.col("size")).alias("share"))


def compact(objects: DataFrame, locators: DataFrame, dead: DataFrame, threshold: float = LIVENESS) -> DataFrame:
    """Containers to rewrite: less than the threshold live, and not retired."""
    return liveness(objects, locators).where(F.col("share") < threshold).join(dead, "container", "left_anti")


def reap(dead: DataFrame, cutoff: int, batch: int) -> DataFrame:
    """Retired containers to delete, in batches by id (of one if the store has no batch delete).

    A batch number is a count over all containers: they are ranked within 256 ranges of the first
    byte, and a range's base is a sum over at most 256 rows.
    """
    due = dead.where(F.col("retired_at") <= cutoff).withColumn("_range", F.substring("container", 1, 2))
    base = due.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = due.withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy("container"))).join(base, "_range")
    return ranked.select("container", "retired_at", F.floor((F.col("_before") + F.col("_rank") - 1) / max(1, batch)).cast("long").alias("batch"))
