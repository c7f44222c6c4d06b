"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from cairnstore.plans import coherence, content, cost, design, garbage, inodes, namespace, packing, store

    return content, packing, namespace, inodes, store, garbage, coherence, cost, design


def queries() -> dict[str, Query]:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
