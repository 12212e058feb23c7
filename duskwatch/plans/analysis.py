"""The whole behavioural analysis: from telemetry to one risk row per graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import scoring as S
from duskwatch.functions.text import redact
from duskwatch.operators import forensics, graphs, similarity
from duskwatch.operators.steps import stored

from .registry import register
from .telemetry import telemetry

# Actions that stand in the evidence of a graph wherever they occur.
HIGH_IMPACT = ("privilege_escalation", "lateral_movement", "exfiltration", "impact", "persistence", "credential_access")


def redacted_events(events: DataFrame, by: str) -> DataFrame:
    """What the analysis reads of events, stored: commands redacted, and ``hidden`` where that changed something."""
    command = redact(F.col("command"))
    return stored(events.select(by, "event_id", "event_type", "ts", "pid", command.alias("command"), (~command.eqNullSafe(F.col("command"))).alias("hidden")), "redacted")


def evidence(clean: DataFrame, by: str) -> DataFrame:
    """(graph, redacted, evidence): of each graph the events with something redacted, and the redacted commands of its path in order."""
    counts = clean.groupBy(F.col(by).cast("string").alias("graph")).agg(F.count_if("hidden").alias("redacted"))
    order = ["ts", "event_id"]
    path = forensics.opening_path(clean, by, F.col("event_type").isin(*HIGH_IMPACT), order)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ts").isNotNull().alias("timed"), *order, "command")))
    listed = path.groupBy(F.col(by).cast("string").alias("graph")).agg(F.transform(ordered, lambda e: e["command"]).alias("evidence"))
    return counts.join(listed, "graph")


def analyse(events: DataFrame, patterns: DataFrame, by: str) -> DataFrame:
    """Redact, build graphs, embed, compare with known patterns (name, threat, embedding), score, list evidence.

    One row per graph: best pattern, similarity, novelty, confidence, risk and level, how many events had something to
    redact, and the redacted commands that are its evidence. Nothing after the first step reads a command as it came.
    """
    clean = redacted_events(events, by)
    embedded = stored(graphs.embed_graphs(clean, by, "event_id", "event_type", "ts", "pid"), "embedded")
    best = similarity.best_patterns(embedded, patterns, "graph", "embedding", 0.7).join(embedded.select("graph", "n_nodes"), "graph")
    s, one = F.col("similarity"), F.lit(1.0)
    novelty = S.distance_novelty(1 - s, 1 - s)
    rows = best.withColumn("novelty", novelty).withColumn("confidence", S.confidence(s, novelty, F.col("matches"), F.col("patterns"), one))
    no = F.lit(False)
    rows = rows.withColumn("risk", S.risk(s, F.col("novelty"), F.col("confidence"), F.col("threat"), no, no))
    rows = rows.join(evidence(clean, by), "graph")
    return rows.select("graph", "n_nodes", F.col("name").alias("pattern"), "similarity", "novelty", "confidence", "risk", S.risk_level(F.col("risk")).alias("level"), "redacted", "evidence")


@register("behaviour_analysis")
def behaviour_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis of host-and-day graphs against the graphs of the first two days as known patterns."""
    t = telemetry(spark, sf_dir).withColumn("graph_id", F.concat_ws(":", "host", F.to_date("ts")))
    first = t.filter("ts < timestamp_ntz '2024-01-03 00:00:00'")
    kinds = F.when(F.hash("graph") % 3 == 0, "APT").when(F.hash("graph") % 3 == 1, "Malware").otherwise("Benign")
    known = graphs.embed_graphs(first, "graph_id", "event_id", "event_type", "ts", "pid").select(F.col("graph").alias("name"), kinds.alias("threat"), "embedding")
    return analyse(t.filter("ts >= timestamp_ntz '2024-01-03 00:00:00'"), known, "graph_id")
