"""Logs with current-state views, settings and rule texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import sinks


def test_upsert_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for i, (value, status) in enumerate([("a", "NEW"), ("b", "NEW"), ("c", "DONE")]):
        df = spark.createDataFrame([("k", value, status), (f"k{i}", value, status)], "key string, value string, status string")
        sinks.append(df, path, F.lit(f"2024-01-0{i + 1} 00:00:00").cast("timestamp"))
    got = {r.key: r.value for r in sinks.current(spark, path, ["key"]).collect()}
    assert got == {"k": "c", "k0": "a", "k1": "b", "k2": "c"}
    marked = sinks.with_status(sinks.current(spark, path, ["key"]), F.col("key") == "k0", "BLOCKED")
    assert marked.filter("status = 'BLOCKED'").count() == 1
    assert [r.old_value for r in sinks.setting_history(spark.read.parquet(path)).filter("key = 'k'").orderBy("version").collect()] == [None, "a", "b"]


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings")
    df = spark.createDataFrame([("a", "1", "core", False), ("b", "2", "ui", False)], "key string, value string, module string, deleted boolean")
    sinks.append(df, path, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert sinks.reset_settings(spark, path, "ui") == 1
    assert [r.key for r in sinks.current(spark, path, ["key"]).collect()] == ["a"]
    bundle = spark.createDataFrame([('[{"key":"max_nodes","value":"7"},{"key":"max_nodes","value":"7000"},{"key":"free","value":"x"}]',)], "bundle string")
    good, bad = sinks.import_bundle(bundle)
    assert sorted(r.key for r in good.collect()) == ["free", "max_nodes"] and [r.error for r in bad.collect()] == ["out of range"]
    assert sinks.export_bundle(good).first().bundle == '[{"key":"free","value":"x"},{"key":"max_nodes","value":"7"}]'


def test_rules_and_rows(spark):
    df = spark.createDataFrame([("bad tool", "evil", ["x", 'say "hi"'])], "name string, word string, parts array<string>")
    row = df.select(sinks.sigma_rule(F.col("name"), F.col("word"), F.lit("high")), sinks.yara_rule(F.col("name"), F.col("parts"))).first()
    assert "CommandLine|contains: 'evil'" in row[0] and "rule bad_tool {" in row[1] and '$s1 = "say \\"hi\\""' in row[1]
    event = spark.sql("select 'e' as event_id, timestamp '2024-01-01' as ts, 'LIVE' as source_mode, 'x' as event_type, named_struct('src_ip', '1.1.1.1', 'dst_ip', '') as network, 'p' as process_name")
    got = sinks.telemetry_row(event).first()
    assert (got.src_ip, got.process_name) == ("1.1.1.1", "p") and '"event_id":"e"' in got.event_json
