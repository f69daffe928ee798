"""All registered queries of the link engine, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkfold.plans import codecs, relational, statistics, storing

PARTS = (codecs, statistics, storing, relational)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in PARTS for k, f in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for p in PARTS for k, q in p.oracle_sql().items()}
