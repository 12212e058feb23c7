"""Stored records on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import records


def test_event_record_fields(spark):
    null = F.lit(None).cast("string")
    made = records.event_record("auth", F.lit("1"), F.lit("t"), {"user": F.lit("u"), "action": null, "success": F.lit(False), "source_ip": F.lit(""), "extra": F.lit(0)})
    row = spark.range(1).select(made.alias("r")).first().r
    assert (row.event_type, row.source_system, row.event_data) == ("auth", "unknown", {"user": "u", "action": None, "success": "false", "extra": "0"})
    with pytest.raises(ValueError, match="needs path"):
        records.event_record("file", null, null, {"action": null})
    with pytest.raises(ValueError, match="unknown event type"):
        records.event_record("odd", null, null, {})


def test_campaign_search_order_and_nulls(spark):
    rows = [("K1", "n", ["T1"], None, "live", "A", 1), ("K2", None, None, ["9.9.9.9"], "LIVE", "A", 3), ("K3", "x", [], [], "LIVE", "B", None), ("K4", "n", [], [], None, "A", 9)]
    df = spark.createDataFrame(rows, "campaign_id string, campaign_name string, technique_ids array<string>, source_ips array<string>, source_mode string, status string, last_seen int")
    ids = lambda **k: [r.campaign_id for r in records.search_campaigns(df, "Live", **k).collect()]
    assert ids() == ["K2", "K1", "K3"] and ids(status="a") == [] and ids(text="9.9") == ["K2"] and ids(text="t1") == ["K1"]


def test_watch_list_keeps_the_latest_reason(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = lambda *r: spark.createDataFrame(list(r), "value string, reason string")
    records.watch(rows(("a", "z"), ("", "x"), (None, "x"), (" b ", None)), path)
    records.watch(rows(("a", "c")), path)
    assert sorted((r.value, r.reason, r.entries) for r in records.watched(spark, path).collect()) == [("a", "c", 2), ("b", None, 1)]


def test_bulk_append_counts_growth_over_batches(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(60).select(F.col("id").cast("string").alias("pattern_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert tuple(records.bulk_append(rows, path, 0, size=2).select("added", "refused", "growth", "retrain").first()) == (60, 0, 60, False)
    more = rows.withColumn("pattern_id", F.concat(F.lit("x"), "pattern_id")).withColumn("embedding", F.when(F.col("pattern_id") != "x3", F.col("embedding")))
    row = records.bulk_append(more, path, 0, size=2).first()
    assert (row.added, row.refused, row.growth, row.triggers) == (59, 1, 119, ["kb_growth"])


def test_playbooks_and_upkeep_of_empty_tables(spark):
    events = spark.createDataFrame([("SCENARIO", None, None, None), ("LIVE", "x", "file", "")], "source_mode string, command string, event_type string, dst_ip string")
    assert sorted((r.source_mode, r.events) for r in records.playbooks(events).collect()) == [("SCENARIO", 0), ("SCENARIO", 0)]
    versions = spark.createDataFrame([], "version long, activated_at long")
    row = records.upkeep(events.limit(0), versions, spark.createDataFrame([], "ts timestamp"), F.current_timestamp(), 0).first()
    assert (row.patterns, row.versions, row.active_version, row.recent_feedback, row.due) == (0, 0, None, 0, [])
