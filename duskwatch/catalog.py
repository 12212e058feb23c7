"""All registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duskwatch.plans import analysis, cluster_queries, forensic_queries, graph_queries, investigation_queries, knowledge_queries, learning_queries, more_queries, novelty_queries, platform_queries, reader_queries, record_queries, registry, relational_queries, stream_queries, telemetry_queries, vector_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in registry.all_queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in registry.all_queries().items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.all_queries()["flagship_activity"].run(spark, sf_dir)
