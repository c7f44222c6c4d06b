"""Content addressing: chunks, ids, manifests, reads by byte range, edits of byte buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnstore.functions.binary import big_endian, joined_bytes, number

CHUNK_SIZE = 4 << 20
SINGLE_OBJECT = 64 << 20
MANIFEST_VERSION = 1
#: Bytes that a buffer may hold.
MOST = 1 << 40


def chunk_id(data: Column | str) -> Column:
    """The hash that names a chunk.  SHA-256, the one hash that engine and oracle share."""
    return F.sha2(data, 256)


def split(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``files`` without content, exploded to idx, data of at most ``size`` bytes each; empty files give no rows."""
    if size <= 0:
        size = CHUNK_SIZE
    n = F.octet_length("content")
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    keep = [c for c in files.columns if c != "content"]
    return files.withColumn("idx", F.explode(starts)).select(
        *keep, F.col("idx").cast("long").alias("idx"), F.substring("content", F.col("idx") * size + 1, F.lit(size)).alias("data")
    )


def chunks(files: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """idx, chunk_id and length of each chunk; the bytes stay behind, so that no shuffle carries them."""
    pieces = split(files, size)
    keep = [c for c in pieces.columns if c != "data"]
    return pieces.select(*keep, chunk_id("data").alias("chunk_id"), F.octet_length("data").cast("long").alias("length"))


def shard(identifier: Column | str) -> Column:
    return F.substring(identifier, 1, 2)


def valid_id(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def manifests(pieces: DataFrame, key: str = "path") -> DataFrame:
    """Per file: content_size and the ordered entries (chunk_id, length, flags)."""
    entries = F.array_sort(F.collect_list(F.struct("idx", "chunk_id", "length", F.lit(0).alias("flags"))))
    return pieces.groupBy(key).agg(F.sum("length").alias("content_size"), entries.alias("entries"))


def encode(content_size: Column, hint: Column, entries: Column) -> Column:
    """The canonical bytes: version, size, hint and count, then id, length and flags of each entry; big-endian."""
    head = F.concat(big_endian(F.lit(MANIFEST_VERSION), 2), big_endian(content_size, 8), big_endian(hint, 4), big_endian(F.size(entries), 4))
    body = F.transform(entries, lambda e: F.concat(F.upper(e["chunk_id"]), big_endian(e["length"], 4), big_endian(e["flags"], 4)))
    return F.unhex(F.concat(head, F.array_join(body, "")))


def decode(data: Column) -> Column:
    """A struct of version, content_size, hint and entries; null if the bytes are cut short or of another version."""
    n = number(data, 15, 4)
    whole = (F.octet_length(data) >= 18) & (number(data, 1, 2) == MANIFEST_VERSION) & (F.octet_length(data) == 18 + 40 * n)

    def entry(i: Column) -> Column:
        at = 19 + 40 * i
        return F.struct(F.lower(F.hex(F.substring(data, at, F.lit(32)))).alias("chunk_id"), number(data, at + 32, 4).alias("length"), number(data, at + 36, 4).alias("flags"))

    entries = F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), entry)).otherwise(F.array().cast("array<struct<chunk_id:string,length:bigint,flags:bigint>>"))
    return F.when(whole, F.struct(number(data, 1, 2).alias("version"), number(data, 3, 8).alias("content_size"), number(data, 11, 4).alias("hint"), entries.alias("entries")))


def content_class(size: Column, n_chunks: Column, threshold: int = SINGLE_OBJECT) -> Column:
    return F.when(size == 0, "empty").when((n_chunks == 1) & (size < threshold), "inline").otherwise("manifest")


def offsets(pieces: DataFrame, key: str = "path") -> DataFrame:
    """Adds the byte range [start, stop) of each chunk in its file."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("length").over(before), F.lit(0))
    return pieces.withColumn("start", start).withColumn("stop", start + F.col("length"))


def read_ranges(placed: DataFrame, reads: DataFrame, data: DataFrame, key: str = "path") -> DataFrame:
    """The bytes [off, off + n) of each read, from chunks' offsets (``placed``) and their ``data``.

    The reads meet the offsets first, an equi-join on the file with the overlap as a residual; only chunks
    that a read touches are fetched.  A read at or past the end gives no row, one that goes past it is short.
    """
    hit = placed.join(reads, key).where((F.col("start") < F.col("off") + F.col("n")) & (F.col("stop") > F.col("off")))
    hit = hit.select(key, "idx", "off", "n", "start", "stop").join(data, [key, "idx"])
    a = F.greatest(F.col("off") - F.col("start"), F.lit(0))
    b = F.least(F.col("off") + F.col("n"), F.col("stop")) - F.col("start")
    part = F.substring("data", (a + 1).cast("int"), (b - a).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("idx", part.alias("part"))))
    return hit.groupBy(key, "off", "n").agg(parts.alias("_parts")).select(key, "off", "n", joined_bytes(F.col("_parts"), "part").alias("bytes"))


def write_at(buffer: Column, data: Column, off: Column) -> Column:
    """``data`` over ``buffer`` at ``off``; a gap is filled with zeros."""
    head = F.rpad(F.substring(buffer, F.lit(1), off.cast("int")), off.cast("int"), F.lit(b"\0"))
    return F.concat(head, data, F.substring(buffer, (off + F.octet_length(data) + 1).cast("int"), F.octet_length(buffer)))


def resize(buffer: Column, size: Column) -> Column:
    return F.rpad(F.substring(buffer, F.lit(1), size.cast("int")), size.cast("int"), F.lit(b"\0"))


def resize_verdict(size: Column) -> Column:
    """A buffer grows to at most 1 TiB."""
    return F.when(size < 0, "EINVAL").when(size > F.lit(MOST), "EFBIG").otherwise("ok")


def fallocate_verdict(off: Column, size: Column, mode: Column) -> Column:
    """ok, or the error's name.  Bits: 1 keep size, 2 punch hole, 8 collapse, 16 zero range, 32 insert."""
    unknown = mode.bitwiseAND(F.lit(~(1 | 2 | 16))) != 0
    hole_grows = (mode.bitwiseAND(F.lit(2)) != 0) & (mode.bitwiseAND(F.lit(1)) == 0)
    # Offsets are unsigned 64-bit there: the sum is compared in decimals.
    past = off.cast("decimal(20,0)") + size.cast("decimal(20,0)") > F.lit(1 << 40)
    return F.when(unknown | hole_grows, "EOPNOTSUPP").when(size == 0, "EINVAL").when(past, "EFBIG").otherwise("ok")
