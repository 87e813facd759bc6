"""Which query is registered under which name, and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslake.plans import answers, evidence, ingest, law, search, store, verify  # noqa: F401  (they register their queries)
from corpuslake.plans import queries as Q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(Q.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of all benchmark questions over all passages, in both jurisdictions."""
    return search.r7_hybrid_search(spark, sf_dir)
