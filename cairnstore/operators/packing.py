"""Deduplication, locators and containers."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cairnstore.sources.shared import shared_dir

SEAL = 128 << 20
ALIGN = 4096


def unique_chunks(pieces: DataFrame, group: str) -> DataFrame:
    """The first chunk (by path, idx) of each id in each group.  Also between unsealed chunks: stored once."""
    first = F.min(F.struct("path", "idx", "length")).alias("first")
    return pieces.groupBy(group, "chunk_id").agg(first).select(group, "chunk_id", "first.path", "first.idx", "first.length")


def missing(pieces: DataFrame, locators: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that no locator of their region names."""
    return pieces.join(locators, keys, "left_anti")


def aligned(length: Column, align: int) -> Column:
    return F.when(F.lit(align) > 1, F.ceil(length / align) * align).otherwise(length).cast("long")


def place(chunks: DataFrame, group: str, align: int = 1) -> DataFrame:
    """Offset of each chunk in one buffer per group: the running sum of padded lengths before it."""
    before = Window.partitionBy(group).orderBy("path", "idx").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(aligned(F.col("length"), align)).over(before), F.lit(0)))


def seal(chunks: DataFrame, group: str, size: int = SEAL, ranges: int | None = None) -> DataFrame:
    """Adds container number and offset: a container is sealed as soon as it holds ``size`` bytes or more.

    The fill at a chunk depends on all chunks before it in its group, but a range of them does so only through
    the place at which it first begins a container, of which a container's worth are possible.  So the rows
    are dealt into ranges of the order and written once; each range says, for each such place, how many
    containers it begins and how full the last one is; a walk over the ranges' tables finds where each
    really begins; and the ranges are numbered, all at a time.
    """
    spark = chunks.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/cairnstore/ranges-{uuid.uuid4().hex}"
    chunks.repartitionByRange(ranges, group, "path", "idx").withColumn("_range", F.spark_partition_id().cast("long")).write.parquet(path)
    stored = spark.read.schema(StructType([*chunks.schema.fields, StructField("_range", LongType())])).parquet(path)
    ordered = lambda df: df.repartition("_range").sortWithinPartitions("_range", group, "path", "idx")
    kind = chunks.schema[group].dataType.simpleString()
    tables = ordered(stored.select(group, "path", "idx", "length", "_range")).mapInArrow(_tables(group, size), f"`{group}` {kind}, _range long, total long, reach array<long>, begun array<long>, filled array<long>")
    entries = tables.repartition(group).sortWithinPartitions(group, "_range").mapInArrow(_entries(group, size), f"`{group}` {kind}, _range long, _number long, _filled long")
    return _numbered(ordered(stored.join(entries, [group, "_range"])), group, size, chunks.schema)


def _segments(batches: Iterable[pa.RecordBatch], group: str, columns: list[str]) -> Iterator[tuple]:
    """(group, range, the columns' values) of the rows of each group in each range."""
    last, held = None, [[] for _ in columns]
    for batch in batches:
        for g, r, *values in zip(*(batch.column(c).to_pylist() for c in (group, "_range", *columns))):
            if held[0] and (g, r) != last:
                yield *last, *held
                held = [[] for _ in columns]
            last = g, r
            for kept, value in zip(held, values):
                kept.append(value)
    if held[0]:
        yield *last, *held


def _tables(group: str, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, r, lengths in _segments(batches, group, ["length"]):
            ends = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))])
            n, total = len(lengths), int(ends[-1])
            following = np.searchsorted(ends, ends[:n] + size)  # where a container that begins here is full
            begun, filled = np.ones(n, np.int64), total - ends[:n]
            for i in range(n - 1, -1, -1):
                j = following[i]
                if j < n:
                    begun[i], filled[i] = begun[j] + 1, filled[j]
            places = int(min(n, np.searchsorted(ends, size) + 1))
            row = {group: g, "_range": r, "total": total, "reach": ends[:places].tolist(), "begun": begun[:places].tolist(), "filled": filled[:places].tolist()}
            yield pa.RecordBatch.from_pylist([row])

    return run


def _entries(group: str, size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, now, first = None, 0, 0, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[group] != last:
                    last, number, now, first = row[group], 0, 0, False
                out.append({group: last, "_range": row["_range"], "_number": number, "_filled": now})
                at = bisect_left(row["reach"], size - now)
                if at < len(row["reach"]):
                    number, now = number + row["begun"][at], row["filled"][at]
                else:
                    now += row["total"]
            if out:
                yield pa.RecordBatch.from_pylist(out)

    return run


def _numbered(rows: DataFrame, group: str, size: int, schema: StructType) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, filled = None, 0, 0
        for batch in batches:
            numbers, offsets = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, (g, r, n, *entry) in enumerate(zip(*(batch.column(c).to_pylist() for c in (group, "_range", "length", "_number", "_filled")))):
                if (g, r) != last:
                    last, (number, filled) = (g, r), entry
                if filled >= size:
                    number, filled = number + 1, 0
                numbers[i], offsets[i] = number, filled
                filled += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names), pa.array(numbers), pa.array(offsets)], names=[*schema.names, "container_no", "offset"])

    return rows.mapInArrow(run, StructType([*schema.fields, StructField("container_no", LongType()), StructField("offset", LongType())]))


def container_id(group: Column | str, number: Column | str) -> Column:
    """A repeatable id in place of a random one."""
    return F.sha2(F.concat_ws(":", group, F.col(number) if isinstance(number, str) else number), 256)


def container_key(region: Column | str, container: Column | str) -> Column:
    return F.concat_ws("/", F.lit("c"), region, F.substring(container, 1, 2), container)


def latest_locators(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins per key."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return picked.select(*keys, "_last.*")


def scrub(locators: DataFrame, containers: DataFrame) -> DataFrame:
    """Adds ok: whether the bytes at the locator have the chunk's length and hash.  A missing container isn't ok.

    A container's locators are gathered before they meet its bytes, so the bytes are moved and held once.
    """
    rest = [c for c in locators.columns if c != "container"]
    placed = locators.groupBy("container").agg(F.collect_list(F.struct(*rest)).alias("_l")).join(containers, "container", "left")

    def checked(x: Column) -> Column:
        data = F.substring(F.col("bytes"), (x["offset"] + 1).cast("int"), x["length"].cast("int"))
        good = (F.octet_length(data) == x["length"]) & (F.sha2(data, 256) == x["chunk_id"])
        return F.struct(*[x[c].alias(c) for c in rest], F.coalesce(good, F.lit(False)).alias("ok"))

    return placed.select("container", F.inline(F.transform("_l", checked))).select(*locators.columns, "ok")


def located(pieces: DataFrame, locators: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` with the container that holds each, or the verdict missing."""
    return pieces.join(locators, keys, "left").withColumn("verdict", F.when(F.col("container").isNull(), "missing").otherwise("ok"))
