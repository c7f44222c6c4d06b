"""Queries over content: chunks, manifests, ranges, dedup ratios, byte edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnstore.functions.binary import joined_bytes
from cairnstore.operators import content as C
from cairnstore.operators import packing as P
from cairnstore.plans.registry import registry
from cairnstore.sources.views import FILES_SQL, chunks_sql, files, table

QUERIES, SQL, query = registry()
_CHUNKS = f"WITH {FILES_SQL}, {chunks_sql(1024)} "
_THRESHOLD = 16384


@query(_CHUNKS + """SELECT lang, count(*) AS chunks, count(DISTINCT chunk_id) AS unique_chunks, CAST(sum(length) AS BIGINT) AS logical_bytes,
  CAST((SELECT sum(l) FROM (SELECT c2.lang, c2.chunk_id, max(c2.length) AS l FROM chunks c2 GROUP BY ALL) u WHERE u.lang = chunks.lang) AS BIGINT) AS physical_bytes
FROM chunks GROUP BY lang""")  # fmt: skip
def dedup_report(spark, sf_dir):
    """What each language's files deduplicate to at 1 KiB chunks.  Two steps, so that a common chunk is combined before the shuffle."""
    each = C.chunks(files(spark, sf_dir), 1024).groupBy("lang", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    return each.groupBy("lang").agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("length")).alias("logical_bytes"), F.sum("length").alias("physical_bytes")
    )


@query(_CHUNKS + "SELECT path, idx, chunk_id, substr(chunk_id, 1, 2) AS shard, length FROM chunks")
def chunk_table(spark, sf_dir):
    return C.chunks(files(spark, sf_dir), 1024).select("path", "idx", "chunk_id", C.shard("chunk_id").alias("shard"), "length")


@query(_CHUNKS + "SELECT substr(chunk_id, 1, 2) AS shard, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS bytes FROM chunks GROUP BY 1")
def shard_histogram(spark, sf_dir):
    return C.chunks(files(spark, sf_dir), 1024).groupBy(C.shard("chunk_id").alias("shard")).agg(F.count(F.lit(1)).alias("chunks"), F.sum("length").alias("bytes"))


_MANIFEST = """m AS (SELECT path, CAST(sum(length) AS BIGINT) AS content_size, count(*) AS n,
  string_agg(upper(chunk_id) || lpad(to_hex(length), 8, '0') || '00000000', '' ORDER BY idx) AS body FROM chunks GROUP BY path),
e AS (SELECT path, content_size, n, sha256(unhex('0001' || lpad(to_hex(content_size), 16, '0') || '00000400' || lpad(to_hex(n), 8, '0') || body)) AS manifest_id,
  18 + 40 * n AS encoded_bytes FROM m)"""


def _manifests(spark, sf_dir):
    found = C.manifests(C.chunks(files(spark, sf_dir), 1024))
    return found.withColumn("encoded", C.encode(F.col("content_size"), F.lit(1024), F.col("entries")))


@query(_CHUNKS + """SELECT path, CAST(sum(length) AS BIGINT) AS content_size, count(*) AS n_chunks, string_agg(substr(chunk_id, 1, 8), ',' ORDER BY idx) AS ids
FROM chunks GROUP BY path""")
def manifest_list(spark, sf_dir):
    found = C.manifests(C.chunks(files(spark, sf_dir), 1024))
    ids = F.array_join(F.transform("entries", lambda e: F.substring(e["chunk_id"], 1, 8)), ",")
    return found.select("path", "content_size", F.size("entries").cast("long").alias("n_chunks"), ids.alias("ids"))


@query(_CHUNKS + f", {_MANIFEST} SELECT path, manifest_id, CAST(encoded_bytes AS BIGINT) AS encoded_bytes FROM e")
def manifest_encoded_id(spark, sf_dir):
    return _manifests(spark, sf_dir).select("path", F.sha2("encoded", 256).alias("manifest_id"), F.octet_length("encoded").cast("long").alias("encoded_bytes"))


@query(_CHUNKS + f", {_MANIFEST} SELECT path, CAST(1 AS BIGINT) AS version, content_size, CAST(1024 AS BIGINT) AS hint, n AS entries, true AS same FROM e")
def manifest_decoded(spark, sf_dir):
    """Round trip: what is decoded from the canonical bytes, and whether it is what was encoded."""
    found = _manifests(spark, sf_dir).withColumn("d", C.decode(F.col("encoded")))
    ids = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["chunk_id"], e["length"].cast("string"))), ",")
    return found.select("path", "d.version", "d.content_size", "d.hint", F.size("d.entries").cast("long").alias("entries"), (ids(F.col("d.entries")) == ids(F.col("entries"))).alias("same"))


@query(_CHUNKS + f", {_MANIFEST} SELECT manifest_id, count(*) AS files, min(path) AS first_path FROM e GROUP BY 1 HAVING count(*) > 1")
def file_dedup_groups(spark, sf_dir):
    found = _manifests(spark, sf_dir).select("path", F.sha2("encoded", 256).alias("manifest_id"))
    return found.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")).where("files > 1")


@query(_CHUNKS + f""", {_MANIFEST} SELECT f.path, CASE WHEN size = 0 THEN 'empty' WHEN c.n = 1 AND size < {_THRESHOLD} THEN 'inline' ELSE 'manifest' END AS class,
  CASE WHEN size = 0 THEN 'empty' WHEN c.n = 1 AND size < {_THRESHOLD} THEN 'inline-' || first ELSE 'manifest-' || manifest_id END AS content_key
FROM files f LEFT JOIN e USING (path) LEFT JOIN (SELECT path, count(*) AS n, min(CASE WHEN idx = 0 THEN chunk_id END) AS first FROM chunks GROUP BY path) c USING (path)""")
def content_class(spark, sf_dir):
    every = files(spark, sf_dir)
    made = _manifests(spark, sf_dir).select("path", F.size("entries").alias("n"), F.element_at("entries", 1)["chunk_id"].alias("first"), F.sha2("encoded", 256).alias("manifest_id"))
    kind = C.content_class(F.col("size"), F.col("n"), _THRESHOLD)
    key = F.when(kind == "empty", "empty").when(kind == "inline", F.concat(F.lit("inline-"), "first")).otherwise(F.concat(F.lit("manifest-"), "manifest_id"))
    return every.select("path", "size").join(made, "path", "left").select("path", kind.alias("class"), key.alias("content_key"))


@query(_CHUNKS + f""", {_MANIFEST}, held AS (SELECT DISTINCT manifest_id FROM e JOIN files USING (path) WHERE doc_id % 2 = 0)
SELECT manifest_id, any_value(CAST(encoded_bytes AS BIGINT)) AS encoded_bytes, manifest_id IN (SELECT manifest_id FROM held) AS existed, count(*) AS files FROM e GROUP BY manifest_id""")
def manifest_store(spark, sf_dir):
    """Manifests put create-only under their ids, into a store that holds those of the even files; one that exists is no error."""
    found = _manifests(spark, sf_dir).select("path", F.sha2("encoded", 256).alias("manifest_id"), F.octet_length("encoded").cast("long").alias("encoded_bytes"))
    even = files(spark, sf_dir).where("doc_id % 2 = 0").select("path")
    held = found.join(even, "path").select("manifest_id").distinct().withColumn("existed", F.lit(True))
    put = found.groupBy("manifest_id").agg(F.first("encoded_bytes").alias("encoded_bytes"), F.count(F.lit(1)).alias("files"))
    return put.join(held, "manifest_id", "left").select("manifest_id", "encoded_bytes", F.coalesce("existed", F.lit(False)).alias("existed"), "files")


@query(_CHUNKS + """SELECT path, idx, start, start + length AS stop FROM (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY path ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM chunks)""")
def manifest_offsets(spark, sf_dir):
    return C.offsets(C.chunks(files(spark, sf_dir), 1024)).select("path", "idx", "start", "stop")


@query(f"""WITH {FILES_SQL} SELECT path, sha256(content[off + 1:off + 3000]) AS hash, CAST(octet_length(content[off + 1:off + 3000]) AS BIGINT) AS n_bytes
FROM (SELECT *, size // 3 AS off FROM files) WHERE off < size""")
def range_read(spark, sf_dir):
    """3,000 bytes from a third of each file on, put together from its chunks."""
    every = files(spark, sf_dir)
    reads = every.select("path", F.floor(F.col("size") / 3).cast("long").alias("off"), F.lit(3000).cast("long").alias("n"))
    placed = C.offsets(C.chunks(every.select("path", "content"), 1024).select("path", "idx", "length"))
    return C.read_ranges(placed, reads, C.split(every.select("path", "content"), 1024)).select("path", F.sha2("bytes", 256).alias("hash"), F.octet_length("bytes").cast("long").alias("n_bytes"))


@query(f"WITH {FILES_SQL} SELECT path, sha256(content) AS hash, size FROM files WHERE size > 0")
def reassembled_hash(spark, sf_dir):
    parts = C.split(files(spark, sf_dir), 1024).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", "data"))).alias("p"))
    joined = joined_bytes(F.col("p"), "data")
    return parts.select("path", F.sha2(joined, 256).alias("hash"), F.octet_length(joined).cast("long").alias("size"))


@query(" UNION ALL ".join(
    f"SELECT * FROM (WITH {FILES_SQL}, {chunks_sql(n)} SELECT CAST({n} AS BIGINT) AS chunk_size, CAST(sum(c * l) AS BIGINT) AS logical_bytes, CAST(sum(l) AS BIGINT) AS physical_bytes, round(sum(c * l) / sum(l), 6) AS ratio "
    "FROM (SELECT chunk_id, count(*) AS c, max(length) AS l FROM chunks GROUP BY 1))" for n in (512, 1024, 4096, 1 << 20)))  # fmt: skip
def dedup_ratio_by_chunk_size(spark, sf_dir):
    """Fixed blocks of several sizes; the largest is whole files."""
    out = None
    for n in (512, 1024, 4096, 1 << 20):
        each = C.chunks(files(spark, sf_dir), n).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("c"), F.max("length").alias("l"))
        row = each.agg(F.sum(F.col("c") * F.col("l")).alias("logical_bytes"), F.sum("l").alias("physical_bytes"))
        row = row.select(F.lit(n).cast("long").alias("chunk_size"), "logical_bytes", "physical_bytes", F.round(F.col("logical_bytes") / F.col("physical_bytes"), 6).alias("ratio"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT doc_id, sha256(CASE WHEN n >= off THEN b[1:off] ELSE b || unhex(repeat('00', CAST(off - n AS INT))) END || encode('PATCH') || b[off + 6:]) AS hash,
  CAST(greatest(n, off + 5) AS BIGINT) AS size FROM (SELECT doc_id, encode(text) AS b, strlen(text) AS n, (doc_id * 37) % 2000 AS off FROM documents)""")
def write_at_offset(spark, sf_dir):
    """Five bytes written somewhere into each file, past its end in some."""
    new = C.write_at(F.col("content"), F.lit(b"PATCH"), F.pmod(F.col("doc_id") * 37, F.lit(2000)))
    return files(spark, sf_dir).select("doc_id", F.sha2(new, 256).alias("hash"), F.octet_length(new).cast("long").alias("size"))


@query("""SELECT doc_id, sha256(CASE WHEN n >= 1000 THEN b[1:1000] ELSE b || unhex(repeat('00', CAST(1000 - n AS INT))) END) AS hash
FROM (SELECT doc_id, encode(text) AS b, strlen(text) AS n FROM documents)""")
def truncate_to(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.sha2(C.resize(F.col("content"), F.lit(1000)), 256).alias("hash"))


@query("""SELECT p_partkey, mode, CASE WHEN (mode & ~19) <> 0 OR ((mode & 2) <> 0 AND (mode & 1) = 0) THEN 'EOPNOTSUPP' WHEN size = 0 THEN 'EINVAL' WHEN off + size > 1099511627776 THEN 'EFBIG' ELSE 'ok' END AS verdict
FROM (SELECT p_partkey, CAST(p_partkey % 40 AS BIGINT) AS mode, CAST(p_size % 7 AS BIGINT) * 4096 AS size, CAST(p_partkey % 3 AS BIGINT) * 549755813888 AS off FROM part)""")
def falloc_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.pmod("p_partkey", F.lit(40)).alias("mode"), (F.pmod("p_size", F.lit(7)).cast("long") * 4096).alias("size"), (F.pmod("p_partkey", F.lit(3)) * (1 << 39)).alias("off")
    )
    return rows.select("p_partkey", "mode", C.fallocate_verdict(F.col("off"), F.col("size"), F.col("mode")).alias("verdict"))


@query(_CHUNKS + "SELECT chunk_id, regexp_matches(id, '^[0-9a-fA-F]{64}$') AS valid FROM (SELECT chunk_id, CASE WHEN idx % 3 = 0 THEN substr(chunk_id, 2) ELSE chunk_id END AS id FROM chunks)")
def id_validation(spark, sf_dir):
    rows = C.chunks(files(spark, sf_dir), 1024)
    return rows.select("chunk_id", C.valid_id(F.when(F.col("idx") % 3 == 0, F.expr("substring(chunk_id, 2)")).otherwise(F.col("chunk_id"))).alias("valid"))


@query(f"WITH {FILES_SQL}, {chunks_sql(1024)} SELECT sha256(encode('key:') || encode(chunk_id)) AS keyed_id, count(*) AS n FROM chunks GROUP BY 1")
def keyed_chunk_ids(spark, sf_dir):
    """Specified, not in the reference's code: ids that depend on a key."""
    return C.chunks(files(spark, sf_dir), 1024).groupBy(F.sha2(F.concat(F.lit("key:"), "chunk_id"), 256).alias("keyed_id")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_partkey, CASE WHEN size < 0 THEN 'EINVAL' WHEN size > 1099511627776 THEN 'EFBIG' ELSE 'ok' END AS verdict FROM (SELECT p_partkey, (p_partkey % 50 - 3) * 34359738368 AS size FROM part)""")
def resize_verdict(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.resize_verdict((F.col("p_partkey") % 50 - 3) * (1 << 35)).alias("verdict"))
