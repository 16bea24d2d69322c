"""All registered queries of the catalog engine, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_queries, search_queries, stream_queries

MODULES = [catalog_queries, search_queries, stream_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for module in MODULES:
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in MODULES:
        out.update(module.SQL)
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["t16_search_batch"](spark, sf_dir)
