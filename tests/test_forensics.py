"""Forensic chains and their parts on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import forensics

T = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)


def tables(spark):
    return (
        spark.createDataFrame([("e1", "c1", T(3)), ("e2", "c1", T(1)), ("e3", None, None), ("e4", None, T(9))], "event_id string, correlation_id string, ts timestamp"),
        spark.createDataFrame([("p2", "e1", None, "k1"), ("p1", "e1", None, None)], "pattern_id string, fingerprint string, related_investigation_id string, related_threat_id string"),
        spark.createDataFrame([("k1", ["e2", "e2", "gone"]), ("k0", ["e1"]), ("k9", None)], "campaign_id string, evidence_event_ids array<string>"),
        spark.createDataFrame([("a1", ["e1", "e2"]), ("a2", ["e3"]), ("a3", [])], "audit_id string, evidence_event_ids array<string>"),
    )


def test_chain_of_each_root(spark):
    roots = spark.createDataFrame([(x,) for x in ("c1", "e1", "e3", "e4", "k1", "a2", "a3", "p1", "zz", "zz", None, "e11")], "root string")
    summary, stages = forensics.evidence_chains(roots, *tables(spark))
    got = {r.root: (r.n_events, r.n_patterns, r.n_campaigns, r.n_actions, r.status) for r in summary.collect()}
    assert got == {
        "c1": (2, 0, 1, 1, "PROVEN_CHAIN"), "e1": (1, 1, 1, 1, "PROVEN_CHAIN"), "e3": (1, 0, 0, 1, "PARTIAL_CHAIN"), "e4": (1, 0, 0, 0, "PARTIAL_CHAIN"),
        "k1": (1, 1, 1, 1, "PROVEN_CHAIN"), "a2": (1, 0, 0, 1, "PARTIAL_CHAIN"), "a3": (0, 0, 0, 1, "PARTIAL_CHAIN"), "p1": (0, 1, 0, 0, "PARTIAL_CHAIN"),
        "zz": (0, 0, 0, 0, "INSUFFICIENT_DATA"), "e11": (0, 0, 0, 0, "INSUFFICIENT_DATA"),
    }
    records = {(r.root, r.stage): r.record for r in stages.filter("stage <> 'TELEMETRY_INGESTION'").collect()}
    assert records[("c1", "CAMPAIGN_ATTRIBUTION")] == "k1"  # the campaign of the earliest event, not the lowest id
    assert records[("e1", "BEHAVIORAL_DNA_ANALYSIS")] == "p1" and records[("k1", "BEHAVIORAL_DNA_ANALYSIS")] == "p2"


def test_chains_of_empty_tables(spark):
    none = [t.limit(0) for t in tables(spark)]
    summary, stages = forensics.evidence_chains(spark.createDataFrame([("r",)], "root string"), *none)
    assert summary.first().status == "INSUFFICIENT_DATA" and stages.count() == 0
    assert forensics.evidence_chains(spark.createDataFrame([], "root string"), *none)[0].count() == 0


def test_latencies(spark):
    events = spark.createDataFrame([("e", T(0)), ("n", None)], "event_id string, ts timestamp")
    rows = [("VERIFIED", T(5), ["e"], 9.0), ("COMPLETED", T(0), ["e"], 2.345), ("FAILED", T(5), ["e"], 1.0), ("VERIFIED", T(5), ["n"], None), ("VERIFIED", None, [], 4.0), ("VERIFIED", T(5), None, -1.0)]
    actions = spark.createDataFrame(rows, "execution_status string, ts timestamp, evidence_event_ids array<string>, duration_seconds double")
    found = forensics.response_latencies(actions, events)
    assert sorted(r.latency for r in found.collect()) == [2.35, 4.0, 5.0]
    row = forensics.latency_statistics(found).first()
    assert (row.sample_size, row["mean"], row.p50, row.p90, row.p95, row.status) == (3, 3.78, 4.0, 5.0, 5.0, "CALCULATED")
    row = forensics.latency_statistics(found.limit(0)).first()
    assert (row.sample_size, row["mean"], row.p50, row.status) == (0, 0.0, 0.0, "INSUFFICIENT_DATA")


def test_relationships_skip_nulls(spark):
    lists = "array<string>"
    rows = spark.createDataFrame([("k", ["1.1.1.1", "1.1.1.1", None], None, [], ["T1"])], f"campaign_id string, source_ips {lists}, destination_ips {lists}, hosts {lists}, technique_ids {lists}")
    nodes, edges = forensics.relationships(rows)
    assert sorted((r.node, r.kind) for r in nodes.collect()) == [("ip-1.1.1.1", "ip"), ("k", "campaign"), ("tech-T1", "technique")]
    assert sorted((r.target, r.label) for r in edges.collect()) == [("ip-1.1.1.1", "OBSERVED_IN"), ("tech-T1", "EXECUTED")]


def test_descendants_end_and_refuse_cycles(spark):
    edges = lambda rows: spark.createDataFrame(rows, "node long, parent long")
    got = forensics.descendants(edges([(2, 1), (3, 2), (4, 2), (4, 2), (9, None), (None, 1)]))
    assert sorted((r.ancestor, r.descendants, r.depth) for r in got.collect()) == [(1, 3, 2), (2, 2, 1)]
    assert forensics.descendants(edges([])).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        forensics.descendants(edges([(1, 2), (2, 1)]), most_levels=3)


def test_similarity_falls_back_on_steps(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [1.0], ["a", "b"], ["b"], None)], "a array<double>, b array<double>, c array<double>, s array<string>, t array<string>, n array<string>")
    s, t, n = F.col("s"), F.col("t"), F.col("n")
    got = row.select(forensics.pattern_similarity(F.col("a"), F.col("b"), s, t), forensics.pattern_similarity(F.col("a"), F.col("c"), s, t), forensics.pattern_similarity(F.lit(None).cast("array<double>"), F.col("c"), n, n)).first()
    assert tuple(got) == (70.7, 50.0, 0.0)
