"""Sequence operators over ordered events of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pairs of actions that count as escalation, and which actions follow which.
ESCALATIONS = (("initial_access", "privilege_escalation"), ("privilege_escalation", "persistence"), ("persistence", "discovery"),
               ("discovery", "lateral_movement"), ("lateral_movement", "collection"), ("collection", "exfiltration"))
RELATED = {
    "execution": ["persistence", "privilege_escalation"],
    "persistence": ["discovery", "lateral_movement"],
    "discovery": ["collection", "exfiltration"],
    "collection": ["exfiltration"],
    "privilege_escalation": ["persistence", "discovery"],
}


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, with fractions."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(1e6)


def consecutive(df: DataFrame, by: list[str], order: list[str], node: str, ts: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges from each row to the next of its group: src, dst, gap_seconds and the carried columns of both ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.select(
        *by,
        F.col(node).alias("src"),
        F.lead(node).over(w).alias("dst"),
        seconds_between(F.col(ts), F.lead(ts).over(w)).alias("gap_seconds"),
        *[x for c in carry for x in (F.col(c).alias(f"src_{c}"), F.lead(c).over(w).alias(f"dst_{c}"))],
    )
    return out.filter("dst is not null")


def transition_type(src: Column, dst: Column) -> Column:
    pair = F.lit(False)
    for a, b in ESCALATIONS:
        pair = pair | ((src == a) & (dst == b))
    return F.when(src == dst, F.lit("continuation")).when(pair, F.lit("escalation")).otherwise(F.lit("temporal"))


def related(src: Column, dst: Column) -> Column:
    table = F.create_map(*[x for k, v in RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return (src == dst) | F.coalesce(F.array_contains(F.try_element_at(table, src), dst), F.lit(False))


def edge_weight(gap: Column, is_related: Column) -> Column:
    time = F.when(gap < 1, F.lit(2.0)).when(gap < 60, F.lit(1.5)).when(gap < 3600, F.lit(1.0)).otherwise(F.lit(0.5))
    return time * F.when(is_related, F.lit(1.5)).otherwise(F.lit(1.0))


def gap_statistics(df: DataFrame, by: list[str], order: list[str], ts: str) -> DataFrame:
    """Per group: events, mean, largest and population variance of gaps, mean change of gaps, bursts and quiet periods."""
    w = Window.partitionBy(*by).orderBy(*order)
    gaps = df.select(*by, *order, seconds_between(F.lag(ts).over(w), F.col(ts)).alias("gap"))
    gaps = gaps.withColumn("change", F.abs(F.col("gap") - F.lag("gap").over(w)))
    return gaps.groupBy(*by).agg(
        F.count("*").alias("n_events"),
        F.avg("gap").alias("mean_gap"),
        F.max("gap").alias("max_gap"),
        F.var_pop("gap").alias("var_gap"),
        F.avg("change").alias("mean_change"),
        F.count_if(F.col("gap") < 5).alias("bursts"),
        F.count_if(F.col("gap") > 300).alias("quiet"),
    )


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: the current state of an append-only log."""
    return first_n(df, key, order, 1)


def first_n(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps only n per key and task before it shuffles."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def dedupe_within(df: DataFrame, key: list[str], ts: str, order: list[str], seconds: float) -> DataFrame:
    """One row per key and window of ``seconds`` that opens at its first event: first_ts, repeats.

    A window closes a fixed time after its first event, so a fold in order of time finds the openings. An event that
    long after the one before always opens a window, so keys are cut there first, and a fold is over the times between
    two such pauses only. Rows without a time are left out.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    in_time = Window.partitionBy(*key).orderBy("__t")
    pause = (F.col("__t") - F.lag("__t").over(in_time) >= int(seconds * 1_000_000)).cast("long")
    df = df.filter(F.col(ts).isNotNull()).select(*key, micros.alias("__t")).withColumn("__p", F.coalesce(pause, F.lit(0)))
    df = df.withColumn("__run", F.sum("__p").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    times = F.array_sort(F.collect_list("__t"))
    zero = F.array().cast("array<struct<first:bigint,n:bigint>>")
    width = int(seconds * 1_000_000)

    def step(acc: Column, t: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.array_append(acc, F.struct(t.alias("first"), F.lit(1).cast("long").alias("n")))
        more = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n")))
        return F.when(F.size(acc) == 0, fresh).when(t - last["first"] >= width, fresh).otherwise(more)

    grouped = df.groupBy(*key, "__run").agg(F.aggregate(times, zero, step).alias("w"))
    opened = grouped.select(*key, F.explode("w").alias("w"))
    return opened.select(*key, F.timestamp_micros("w.first").cast("timestamp_ntz").alias("first_ts"), F.col("w.n").alias("repeats"))
