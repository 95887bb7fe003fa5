"""Registered queries over the provided tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinstrand.plans import cluster_queries, read_queries, sequence_queries, source_queries

_MODULES = (sequence_queries, cluster_queries, read_queries, source_queries)
Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["cluster_kmer_greedy_fast"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
