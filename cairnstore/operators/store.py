"""The object store's operations as relations: reads by range, stat, puts, deletes, capabilities; locators and containers over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Backend, conditional put, multipart upload, objects in a batch delete (0: none), storage tiers, largest object (0: no limit stated).
CAPABILITIES = (
    ("local", True, False, 0, [], 1 << 40),
    ("s3", True, False, 0, ["STANDARD", "STANDARD_IA", "GLACIER"], 0),
    ("gcs", True, False, 0, ["STANDARD", "NEARLINE", "COLDLINE", "ARCHIVE"], 0),
    ("azure", True, False, 0, ["Hot", "Cool", "Cold", "Archive"], 0),
)
BLOCK = 4096


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "backend string, conditional_put boolean, multipart boolean, batch_delete long, tiers array<string>, max_object long")


def stat(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """``requests`` (key, ...) with the object's size, or the verdict ENOENT."""
    return requests.join(objects.select("key", "size"), "key", "left").withColumn("verdict", F.when(F.col("size").isNull(), "ENOENT").otherwise("ok"))


def get(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """``requests`` (key, off, n, ...) with the bytes [off, off + n), to the object's end if n is below 0; ENOENT without an object."""
    found = requests.join(objects.select("key", F.col("content").alias("_c")), "key", "left")
    n = F.when(F.col("n") < 0, F.octet_length("_c")).otherwise(F.col("n"))
    data = F.substring("_c", (F.col("off") + 1).cast("int"), n.cast("int"))
    return found.withColumn("bytes", data).withColumn("verdict", F.when(F.col("_c").isNull(), "ENOENT").otherwise("ok")).drop("_c")


def get_into(wanted: Column, got: Column) -> Column:
    """Whether a read filled its buffer: an empty buffer needs no read, a short read is an error."""
    return F.when(wanted == 0, "noop").when(got.isNull(), "ENOENT").when(got < wanted, "short").otherwise("ok")


def is_aligned(*quantities: Column) -> Column:
    """Whether file offset, length, buffer address and device offset all are multiples of a block."""
    every = F.lit(True)
    for q in quantities:
        every = every & (q % BLOCK == 0)
    return every


def put(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """``requests`` (key, seq, if_absent) with what each gives: created, replaced, or EEXIST if it must not exist but does.

    A key's earlier requests count: after the first of them it exists, whatever that one's kind.
    """
    found = requests.join(objects.select("key", F.lit(True).alias("_there")), "key", "left")
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq")) == 1
    exists = F.col("_there").isNotNull() | ~first
    return found.withColumn("verdict", F.when(exists & F.col("if_absent"), "EEXIST").when(exists, "replaced").otherwise("created")).drop("_there")


def delete(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """``requests`` (key, place) with deleted (false: absent, which is success too); a key is there for its first request only."""
    found = requests.join(objects.select("key", F.lit(True).alias("_there")), "key", "left")
    first = F.row_number().over(Window.partitionBy("key").orderBy("place")) == 1
    return found.withColumn("deleted", F.col("_there").isNotNull() & first).withColumn("verdict", F.lit("ok")).drop("_there")


def ingest_totals(entries: DataFrame) -> DataFrame:
    """What a walk of a source tree (kind, dir, size) publishes: files with links, directories, bytes of regular files; other kinds are skipped."""
    taken = entries.where(F.col("kind").isin("file", "link", "dir"))
    return taken.agg(
        F.count_if(F.col("kind") != "dir").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"), F.coalesce(F.sum(F.when(F.col("kind") == "file", F.col("size"))), F.lit(0).cast("long")).alias("bytes")
    )


def locator_state(log: DataFrame) -> DataFrame:
    """What a log of locator puts and deletes leaves: the last put of each chunk, unless a delete came after it."""
    last = log.groupBy("region", "chunk_id").agg(F.max_by(F.struct("op", "container"), F.struct("at", "seq")).alias("l"))
    return last.where("l.op = 'put'").select("region", "chunk_id", "l.container")


def first_mentions(log: DataFrame) -> DataFrame:
    """Per container: when the first put named it, which is its seal time for good."""
    return log.where("op = 'put'").groupBy("container").agg(F.min("at").alias("sealed_at"), F.count(F.lit(1)).alias("puts"))


def pending(packed: DataFrame, group: str, size: int) -> DataFrame:
    """Chunks in a group's last container, if that isn't full: they are buffered, and live though no locator names them."""
    open_ = packed.groupBy(group).agg(F.max(F.struct("container_no", (F.col("offset") + F.col("length")).alias("filled"))).alias("_e"))
    open_ = open_.where(F.col("_e.filled") < size).select(group, F.col("_e.container_no").alias("container_no"))
    return packed.join(open_, [group, "container_no"], "left_semi")


def reachable_files(files: DataFrame, detached: DataFrame) -> DataFrame:
    """Files under no detached directory: what a walk from the root meets.  ``files`` has path and ancestors (path, ancestor)."""
    lost = files.join(detached, "ancestor", "left_semi").select("path").distinct()
    return files.select("path").distinct().join(lost, "path", "left_anti")


def sweep_ticks(graveyard: DataFrame, pinned: DataFrame, every: int, grace: int) -> DataFrame:
    """Per unpinned inode: the first tick of a regular sweep that finds its grace over; later ticks find nothing left to do."""
    due = graveyard.join(pinned, "inode", "left_anti")
    return due.select("inode", F.ceil((F.col("deleted_at") + grace) / every).cast("long").alias("tick"))
