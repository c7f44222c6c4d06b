"""Token ids in ORC files.

Documents are range-partitioned by id, so that the files follow one another in the order of the ids
and no task holds more than its range.  Each row holds a document's ids (run-length encoded by ORC),
its place in the part and the number of ids before it in the part.  The files carry row indexes and
Bloom filters on ``doc_id``: a reader that looks for some documents skips stripes and row groups by
metadata, and whole reads run by stripe.

A document's start in the corpus is its start in the part plus the sum of the parts before it; the
running sum is over one row per part, not per document.

Defined results: a null text is an empty text, which has the end id alone; rows with equal ids, or
with none, stand in the order of their texts' hashes and may lie in several parts; rows with a null id come first; an empty table gives no rows; a text
of any length is one row; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cairnstore.llm.bpe import default_tokenizer, encoder
from cairnstore.llm.common import fresh_path, give_back, text_or_empty

END_ID = 2
#: Rows that go to a Python worker at once while the files are written.
ROWS = 2000
SCHEMA = "doc_id long, part int, row_in_part long, start_in_part long, n_tokens long, ids array<int>"
OPTIONS = {
    "compression": "none",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(8 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encoded(batches: Iterable[pa.RecordBatch], tokens: str, end_id: int, part: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` for a part's documents.  Six processes share an executor's memory: what a slice took goes back after it."""
    row, start = 0, 0
    for batch in batches:
        for low, high, ids, at in encoder(tokens).slices(batch.column("_cs_text")):
            ids = np.insert(ids, at[1:], end_id).view(np.int32)
            offsets = at + np.arange(len(at))
            for a in range(0, high - low, 256):
                own = offsets[a : a + 257]
                n = len(own) - 1
                columns = [
                    batch.column("doc_id").slice(low + a, n), pa.array(np.full(n, part, np.int32)),
                    pa.array(row + np.arange(n)), pa.array(start + own[:-1] - own[0]), pa.array(np.diff(own)),
                    pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids[own[0] : own[-1]])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "row_in_part", "start_in_part", "n_tokens", "ids"])
                row, start = row + n, start + int(own[-1] - own[0])
            del ids, columns
            give_back()


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode every row's whole text, append ``end_id`` and write the ids to ``path``."""
    tokens = tokenizer or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, tokens, end_id, TaskContext.get().partitionId())

    picked = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_cs_text"))
    picked = picked.withColumn("_cs_hash", F.xxhash64("_cs_text"))
    ordered = picked.repartitionByRange("doc_id", "_cs_hash").sortWithinPartitions("doc_id", "_cs_hash", "_cs_text").drop("_cs_hash")
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), ROWS)))
    try:
        ordered.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(path)
    finally:
        spark.conf.set(name, before)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def starts(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``start``: the ids of all documents before each."""
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_cs_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_cs_n").over(before), F.lit(0)).alias("_cs_before"))
    return tokens.join(parts, "part").withColumn("start", F.col("_cs_before") + F.col("start_in_part")).drop("_cs_before")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, the number of ids that were read and the CRC-32 of their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("start_in_part"), pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
    return tokens.select("doc_id", "part", "start_in_part", "ids").mapInArrow(run, schema)


def store_and_read(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to ORC and return doc_id, start, n_tokens and ids_crc32 as read from the files."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write(docs, path, tokenizer)
    tokens = read(spark, path)
    parts = starts(tokens.select("part", "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).withColumn("start_in_part", F.lit(0).cast("long")))
    summed = checksums(tokens).join(parts.select("part", F.col("start").alias("_cs_before")), "part")
    return summed.select("doc_id", (F.col("_cs_before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
