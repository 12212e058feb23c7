"""Forensic chains where one id has most of the events, so that Spark splits its join."""

from __future__ import annotations

import pytest

from duskwatch.operators import forensics

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_chains_of_a_frequent_id(splitting):
    n = 20_000
    events = splitting.range(0, n, 1, 8).selectExpr("concat('E', id) AS event_id", "CASE WHEN id % 50 = 0 THEN concat('C', id) ELSE 'C1' END AS correlation_id", "timestamp_seconds(id) AS ts")
    campaigns = splitting.createDataFrame([("K1", ["E1", "E2"]), ("K2", ["E2"])], "campaign_id string, evidence_event_ids array<string>")
    actions = splitting.createDataFrame([("A1", ["E2"])], "audit_id string, evidence_event_ids array<string>")
    patterns = splitting.createDataFrame([("P1", "E2", None, "C1")], "pattern_id string, fingerprint string, related_investigation_id string, related_threat_id string")
    roots = events.selectExpr("event_id AS root").union(splitting.createDataFrame([("C1",), ("K2",), ("A1",), ("X",)], "root string"))
    found = {r.root: r for r in forensics.evidence_chains(roots, events, patterns, campaigns, actions)[0].collect()}
    assert len(found) == n + 4
    facts = lambda root: (found[root].n_events, found[root].n_patterns, found[root].n_campaigns, found[root].n_actions, found[root].status)
    assert facts("C1") == (n - n // 50, 1, 1, 1, "PROVEN_CHAIN")
    assert facts("E2") == (1, 1, 1, 1, "PROVEN_CHAIN") and facts("E3") == (1, 0, 0, 0, "PARTIAL_CHAIN")
    assert facts("K2") == (1, 0, 1, 1, "PROVEN_CHAIN") and facts("A1") == (1, 0, 1, 1, "PROVEN_CHAIN") and facts("X") == (0, 0, 0, 0, "INSUFFICIENT_DATA")
