"""Content-defined chunks, and what a way of cutting deduplicates to."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes in a chunk: least and most, and the mask that a cut's hash has clear.
LEAST, MOST, MASK = 256, 8192, 0x3FF
#: Specified: content-defined chunks are worth their cost above this ratio.
WORTH = 1.15


def cuts(data: bytes, least: int = LEAST, most: int = MOST, mask: int = MASK) -> list[int]:
    """Ends of the chunks: where a hash of the last 32 bytes has the mask clear, between ``least`` and ``most`` bytes."""
    h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    power = 0x85EBCA6B
    for width in (1, 2, 4, 8, 16):  # after each step h covers twice as many bytes
        step = h.copy()
        step[width:] += h[:-width] * np.uint32(power)
        h, power = step, power * power & 0xFFFFFFFF
    h ^= h >> np.uint32(15)
    found, at = [], 0
    for mark in [*(np.flatnonzero((h & np.uint32(mask)) == 0) + 1).tolist(), len(data)]:
        while mark - at > most:
            at += most
            found.append(at)
        if mark - at >= least or (mark == len(data) and mark > at):
            at = mark
            found.append(at)
    return found


def content_defined(files: DataFrame, least: int = LEAST, most: int = MOST, mask: int = MASK) -> DataFrame:
    """path, idx, chunk_id and length of each file's content-defined chunks; nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py() or b""
                ends = cuts(data, least, most, mask)
                begins = [0, *ends[:-1]]
                columns = [[path] * len(ends), list(range(len(ends))), [sha256(data[a:b]).hexdigest() for a, b in zip(begins, ends)], [b - a for a, b in zip(begins, ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["path", "idx", "chunk_id", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, idx long, chunk_id string, length long")


def ratio(pieces: DataFrame) -> DataFrame:
    """Logical and physical bytes, their ratio, and whether it is worth it."""
    each = pieces.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    total = each.agg(F.sum(F.col("n") * F.col("length")).alias("logical_bytes"), F.sum("length").alias("physical_bytes"))
    share = F.try_divide("logical_bytes", "physical_bytes")
    return total.select("logical_bytes", "physical_bytes", F.round(share, 6).alias("ratio"), (share > WORTH).alias("worth"))
