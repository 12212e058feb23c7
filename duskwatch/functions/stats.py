"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(col: Column | str, p: float) -> Column:
    """Floor-index nearest rank: the value at min(int(n * p), n - 1) of the sorted non-null values; null if none.

    An aggregate expression. It collects the values of a group, so it is meant for groups of bounded size.
    """
    values = F.array_sort(F.collect_list(col))
    n = F.size(values)
    at = F.least(F.floor(n * F.lit(float(p))), (n - 1).cast("long"))
    return F.when(n > 0, F.get(values, at.cast("int")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
