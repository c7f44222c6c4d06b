"""Shared helpers of the corpus operators."""

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: The separators of words: space and the ASCII controls from tab to carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where it is unset on one machine (tests) a temporary folder takes its place; a cluster must
    name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="cairnstore-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairnstore/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread, not a recomputation of what stands above.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cs_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`staged` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._cs_path
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps whose results are written: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return the memory that this process has freed but its allocators hold on to; on other C libraries than glibc only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of record batches whose worker gives its memory back when a task ends."""

    @wraps(run)
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python workers ``BATCH_BYTES`` at a time at most.

    Spark fills batches by rows, 10,000 of them: of whole texts these are 50 MB, which the executor's JVM holds
    beside its heap, with as much again while a buffer grows, and the worker once more, for each core.
    """
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES))) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def own_names_apart(stage: Callable) -> Callable:
    """A stage whose own columns begin with ``_cs_``: such columns of ``docs`` get other names on the way through."""

    @wraps(stage)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        if not any(c.startswith("_cs_") for c in docs.columns):
            return stage(docs, *args, **kwargs)
        apart = docs.toDF(*(f"kept_{n}{c}" if c.startswith("_cs_") else c for n, c in enumerate(docs.columns)))
        return stage(apart, *args, **kwargs).toDF(*docs.columns)

    return run


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Stored tables of more files than this are numbered by a join that isn't broadcast.
FEW_FILES = 100_000
#: Bits of a row's number that count rows within a file; the others number the files.
ROW_BITS = 40


def numbered(docs: DataFrame, name: str = "uid") -> DataFrame:
    """``docs`` with a number for each row that doesn't depend on how the table is read.

    A row of a stored table is named by its file's place among the sorted file names and its place in
    that file, so every scan gives the same numbers, whatever the split sizes and whichever executors
    are there.  Anything else is written to the shared folder first, together with its numbers.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation" or not plan.relation().toString().lower().startswith("parquet"):
        return staged(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    meta = docs.metadataColumn("_metadata")
    paths = docs.select(meta["file_path"].alias("_cs_file")).distinct()
    files = staged(paths.select("_cs_file", (F.row_number().over(Window.orderBy("_cs_file")) - 1).cast("long").alias("_cs_place")), "files")
    placed = docs.select("*", meta["file_path"].alias("_cs_file"), meta["row_index"].alias("_cs_index"))
    small = files.count() <= FEW_FILES
    placed = placed.join(F.broadcast(files) if small else files, "_cs_file")
    return placed.withColumn(name, F.shiftleft("_cs_place", ROW_BITS).bitwiseOR(F.col("_cs_index"))).drop("_cs_file", "_cs_place", "_cs_index")


#: Bytes of the bits that tell rows apart without a join: few enough to travel with a task.
BITMAP = 1 << 19


def marks(keys: DataFrame, name: str = "uid") -> np.ndarray:
    """Bits, one of which is set for each value of the long column ``name``.

    They are ``BITMAP`` bytes at any size, so they may go to every task; where so many are set that they tell
    little, more rows take the way through the join that follows, with the same result.
    """
    words = BITMAP // 8
    h = F.xxhash64(name)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int"))
    rows = keys.groupBy(F.pmod(h, F.lit(words)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def bits_of(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each value (as ``xxhash64`` of it) is set: true for all that were marked, and for few others."""
    return bits[hashes % len(bits)] >> ((hashes.view(np.uint64) >> np.uint64(32)) & np.uint64(63)) & np.uint64(1) > 0


def marked(bits: np.ndarray, name: str = "uid") -> Column:
    @F.arrow_udf("boolean")
    def test(hashes: pa.Array) -> pa.Array:
        return pa.array(bits_of(hashes.to_numpy(), bits))

    return test(F.xxhash64(name))


def without_rows(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``rows`` but for those whose number ``name`` is in ``gone``; most rows aren't shuffled."""
    test = marked(marks(gone, name), name)
    return rows.where(~test).unionByName(rows.where(test).join(gone, name, "left_anti"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each node of ``edges``; root is the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) over a table of edges until
    the edges no longer change; each step is a grouped minimum (combined before the shuffle) and
    an equi-join, and its result goes to the shared folder.  Nothing is gathered on the driver but
    a count and a checksum.  An empty table gives an empty result; loops are ignored.
    """
    current = staged(
        edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct(), "edges"
    )
    mark = _checksum(current)
    while mark[0]:
        previous = current
        both = current.unionByName(current.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(low, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lowest, "x").select(
            F.explode(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct("x", F.col("m").alias("y")))).alias("e")
        )
        current = staged(small.select("e.x", "e.y").where("x <> y").distinct(), "edges")
        discard(previous)
        now = _checksum(current)
        if now == mark:
            break
        mark = now
    member = current.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return member.unionByName(current.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y")), F.sum(F.pmod(F.xxhash64("y", "x"), F.lit(1 << 30)))).first()
    return tuple(row)
