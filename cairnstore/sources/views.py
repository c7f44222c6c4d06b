"""Views that turn the tables into catalogue tables: files, objects, mutations, observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: How event types read as operations on the catalogue.
OPERATIONS = {"view": "lookup", "click": "grant", "purchase": "commit", "signup": "create", "error": "unlink"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, path /lang/source/doc_id, its dir and name, content as bytes and size."""
    name = F.col("doc_id").cast("string")
    folder = F.concat(F.lit("/"), "lang", F.lit("/"), "source")
    content = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat(folder, F.lit("/"), name).alias("path"), folder.alias("dir"), name.alias("name"),
        content.alias("content"), F.octet_length(content).cast("long").alias("size"),
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, at (microseconds), holder, op and object, from the event log."""
    op = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("user_id").alias("holder"),
        op.alias("op"), F.get_json_object("props", "$.k").cast("long").alias("object"), "value",
    )


def egress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item: from the supplier's region to the customer's, USD and orders' subtree."""
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    src = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("src_region"))
    dst = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("dst_region"), F.concat(F.lit("/"), F.lower("c_mktsegment")).alias("subtree"))
    orders = t("orders").select("o_orderkey", "o_custkey").join(dst, F.col("o_custkey") == F.col("c_custkey"))
    return (
        t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(src, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("src_region", "dst_region", "subtree", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("usd"))
    )


# The same views for the oracle.
FILES_SQL = """files AS (
  SELECT doc_id, lang, '/' || lang || '/' || source || '/' || doc_id AS path, '/' || lang || '/' || source AS dir, CAST(doc_id AS VARCHAR) AS name,
         encode(text) AS content, CAST(strlen(text) AS BIGINT) AS size
  FROM documents)"""
MUTATIONS_SQL = """mutations AS (
  SELECT event_id AS seq, epoch_us(ts) AS tm, user_id AS holder, CAST(json_extract_string(props, '$.k') AS BIGINT) AS object, value,
         CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'grant' WHEN 'purchase' THEN 'commit' WHEN 'signup' THEN 'create' WHEN 'error' THEN 'unlink' END AS op
  FROM events)"""
EGRESS_SQL = """egress AS (
  SELECT rs.r_name AS src_region, rc.r_name AS dst_region, '/' || lower(c_mktsegment) AS subtree, l_quantity AS quantity, l_extendedprice AS usd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
  JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ns ON s_nationkey = ns.n_nationkey
  JOIN region rs ON ns.n_regionkey = rs.r_regionkey)"""


def chunks_sql(size: int) -> str:
    return f"""chunks AS (
  SELECT doc_id, lang, path, dir, idx, sha256(piece) AS chunk_id, CAST(octet_length(piece) AS BIGINT) AS length
  FROM (SELECT *, content[idx * {size} + 1:(idx + 1) * {size}] AS piece
        FROM (SELECT *, unnest(range(0, CAST((size + {size - 1}) // {size} AS BIGINT))) AS idx FROM files)))"""
