"""Registry of queries: a name, a function of (session, folder), and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


_found: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Register the decorated function of (session, folder) under ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        if name in _found:
            raise ValueError(f"query {name} is registered twice")
        _found[name] = Query(f, sql)
        return f

    return add


def all_queries() -> dict[str, Query]:
    return dict(_found)


@register(
    "flagship_activity",
    """
    SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
           avg(value) AS mean_value
    FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
    """,
)
def flagship_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return (
        events.filter("ts is not null")
        .groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.avg("value").alias("mean_value"))
    )
