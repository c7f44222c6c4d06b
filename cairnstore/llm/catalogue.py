"""The thin queries over the operators, and oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnstore.llm import bpe, mpeg_audio, packing, pii, quality_fm, quality_rules, simhash, suffix_dedup, token_orc, toxicity
from cairnstore.llm.common import documents, labels


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir)).select("doc_id", *quality_rules.METRICS, "base_failed", "kept")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.store_and_read(documents(spark, sf_dir))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_fm.score(docs, quality_fm.train(docs, labels(spark, sf_dir)))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("source", "cluster")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.store_and_read(documents(spark, sf_dir))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op10_pii_bilstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_quality_rules, op2_token_orc, op3_quality_fm, op4_simhash, op5_best_fit_packing,
        op6_suffix_dedup, op7_bpe_round_trip, op8_mpeg_audio, op9_toxicity_chain, op10_pii_bilstm,
    ]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM d
), g AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2
), c AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g
), p AS (
  SELECT r, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY r
), m AS (
  SELECT d.r, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN p USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT host, count(*) AS n, sum(CAST(base_failed AS INT)) AS k FROM f GROUP BY host
), s AS (
  SELECT sum(k) / sum(n) AS mean, sum(n * (k / n) * (k / n)) / sum(n) AS s2, count(*) AS hosts, sum(n) AS n FROM h
), e AS (
  SELECT mean, mean * (1 - mean) AS chance, greatest(0.0, s2 - mean * mean) - mean * (1 - mean) * hosts / n AS extra FROM s
), b AS (
  SELECT mean, CASE WHEN extra > 1e-12 AND chance > 0 THEN least(greatest(chance / extra - 1, 2.0), 1000.0) ELSE 1000.0 END AS strength FROM e
), v AS (
  SELECT host, (k + greatest(mean * strength, 1e-3)) / (n + greatest(mean * strength, 1e-3) + greatest((1 - mean) * strength, 1e-3)) <= 0.6 AS host_ok
  FROM h, b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept
FROM f JOIN v USING (host)
"""


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: they have tests against brute force, round trips or held-out rows."""
    return {"op1_quality_rules": OP1_SQL}
