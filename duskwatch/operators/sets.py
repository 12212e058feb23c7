"""Unions, differences and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feed(branches: dict[str, DataFrame], key: str, order: str) -> DataFrame:
    """Union of branches by column name; of rows with one key the first branch's earliest stays."""
    from .windows import latest

    parts = [df.withColumn("branch", F.lit(name)).withColumn("priority", F.lit(i)) for i, (name, df) in enumerate(branches.items())]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return latest(union, [key], [F.col("priority"), F.col(order)]).drop("priority")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Per key of either snapshot: create, delete or modify; unchanged keys are left out."""
    a, b = before.select(key, F.struct(*compare).alias("old")), after.select(key, F.struct(*compare).alias("new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("old").isNull(), F.lit("create")).when(F.col("new").isNull(), F.lit("delete")).when(~F.col("old").eqNullSafe(F.col("new")), F.lit("modify"))
    return both.select(key, change.alias("change")).filter("change is not null")
