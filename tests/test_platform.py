"""Numbering, chunks, unique keys, published tables, enrichment and the syslog source against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import enrichment, numbering, tables
from duskwatch.sources import plugins
from duskwatch.streaming import streams

from .plain import spectral_embedding


def test_numbers_with_ties_nulls_and_a_large_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, 1, 2, 3]), i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, number_of int").repartition(7)
    got = [tuple(r) for r in numbering.numbered(df, ["v"], ["g"], "n", 16).collect()]
    for g in ("a", "b", None):
        mine = sorted((r[3], -1 if r[1] is None else r[1]) for r in got if r[0] == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted(v for _, v in mine)
    assert sorted(map(repr, rows)) == sorted(repr(r[:3]) for r in got)


def test_numbers_of_an_empty_table_and_equal_rows(spark):
    assert numbering.numbered(spark.createDataFrame([], "v int"), ["v"]).collect() == []
    same = numbering.numbered(spark.range(500).select(F.lit(1).alias("v")).repartition(5), ["v"], partitions=8)
    assert sorted(r.number for r in same.collect()) == list(range(1, 501))


def test_retention_counts_equal_rows(spark):
    rows = [(1, False)] * 6 + [(0, True)] * 3 + [(0, None)] + [(5, False)] * 2
    df = spark.createDataFrame(rows, "v int, held boolean")
    got = sorted((tuple(r) for r in numbering.retention(df, ["v"], F.col("held"), 8).collect()), key=repr)
    assert got == sorted([(1, False)] * 2 + [(0, True)] * 3 + [(0, None)] + [(5, False)] * 2, key=repr)
    assert numbering.retention(df, ["v"], F.col("held"), 12).count() == 12


def test_chunk_patterns(spark):
    rows = [("d", i, "discovery", None if i < 3 else f"2024-01-01 00:{i // 60:02}:{i % 60:02}", i % 4, i == 130) for i in range(250)] + [(None, 0, "x", "2024-01-01 00:00:00", 1, None)]
    events = spark.createDataFrame(rows, "d string, id int, action string, t string, pid int, bad boolean").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.dataset, r.chunk): r for r in numbering.chunk_patterns(events, "d", "id", "action", "t", "pid", F.col("bad")).collect()}
    assert {k: (r.event_count, r.threat_class) for k, r in got.items()} == {("d", 0): (100, "Benign"), ("d", 1): (100, "Malware"), ("d", 2): (50, "Benign"), (None, 0): (1, "Benign")}
    assert got["d", 1].edge_count == 99 + 96 and len(got["d", 2].embedding) == 128
    plain = spectral_embedding(np.asarray(got["d", 1].features))
    assert np.allclose(plain, got["d", 1].embedding)


def test_two_unique_keys_as_a_replay(spark):
    rng = random.Random(5)
    log = [(rng.choice([None, *range(6)]), rng.choice([None, *"abcdef"]), i) for i in range(400)]
    table: list[tuple] = []
    for k, f, i in log:
        table = [r for r in table if not (k is not None and r[0] == k or f is not None and r[1] == f)] + [(k, f, i)]
    got = tables.replaced(spark.createDataFrame(log, "k int, f string, i int"), ["k", "f"], ["i"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(table, key=repr)


def test_readers_see_one_version(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        tables.read_version(spark, path)
    assert tables.publish(spark.range(5), path) == 1
    before = tables.read_version(spark, path)
    tables.write_version(spark.range(100), path)  # a writer that dies before it publishes
    assert tables.read_version(spark, path).count() == 5
    failing = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        tables.publish(failing, path)
    assert tables.read_version(spark, path).count() == 5
    assert tables.publish(tables.read_version(spark, path).filter("id > 2"), path) == 2
    assert before.count() == 5 and tables.read_version(spark, path).count() == 2 and tables.read_version(spark, path, 1).count() == 5
    assert tables.compact(spark, path, 1) == 3 and sorted(r.id for r in tables.read_version(spark, path).collect()) == [3, 4]
    assert [r.version for r in tables.versions(spark, path).orderBy("version").collect()] == [1, 2, 3]


def test_enrichment_word_by_word(spark):
    vulnerabilities = spark.createDataFrame([(f"CVE-{i}", "Acme", f"tool {i % 2}") for i in range(6)] + [("CVE-2026-48908", "other", "page")], "cve_id string, vendor string, product string")
    rows = [
        ("order", {"a": "acme", "b": "CVE-9 x", "c": "CVE-5 seen", "d": "tool 1"}, 0.0),
        ("none", {"a": "nothing"}, 0.0),
        ("short", {"a": "too"}, 0.0),
        ("novel", {}, 0.9),
        ("plain", None, 0.1),
        ("null", {"a": None, "b": "  CVE-1"}, None),
    ]
    profiles = spark.createDataFrame(rows, "id string, metadata map<string,string>, novelty double")
    got = {r.id: r.related_vulnerabilities for r in enrichment.vulnerabilities_of(profiles, "id", vulnerabilities).collect()}
    assert got == {
        "order": ["CVE-0", "CVE-1", "CVE-2", "CVE-5", "CVE-1"], "none": ["CVE-2026-48908"], "short": ["CVE-2026-48908"], "novel": ["CVE-2026-48908"], "null": ["CVE-1"],
    }


def test_enrichment_without_anything(spark):
    schema = "id int, techniques array<string>, intents array<string>, features array<string>, critical_path array<string>, metadata map<string,string>, novelty double"
    empty = lambda s: spark.createDataFrame([], s)
    sources = [empty("technique_id string, name string, tactics array<string>"), empty("pattern_id string, name string, description string"),
               empty("cve_id string, vendor string, product string"), empty("sha256 string, signature string"), empty("ip string, status string")]
    rows = [(1, None, None, None, None, None, None), (2, ["T1"], [], ["f" * 64], ["some word"], {"dest_ip": "1.1.1.1"}, 0.95)]
    got = {r.id: r for r in enrichment.enrich(spark.createDataFrame(rows, schema), "id", *sources).collect()}
    assert got[1].mitre_techniques is None and got[1].malware_correlation is None and got[1].related_vulnerabilities == []
    assert got[2].mitre_techniques[0].name == "Technique T1" and got[2].malware_correlation == [] and got[2].related_vulnerabilities == []
    assert enrichment.enrich(empty(schema), "id", *sources).collect() == []


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_syslog_ranges(spark, tmp_path, most):
    plugins.register(spark)
    lines = ["", "é" * 9, "b", "", "c\r", "a long line " * 20, "last without an end"]
    (tmp_path / "one.log").write_bytes("\n".join(lines).encode() + b"\xff")
    (tmp_path / "_hidden").write_text("no\n")
    (tmp_path / "empty.log").write_text("")
    got = spark.read.format("syslog").option("rangeBytes", most).load(str(tmp_path)).orderBy("at").collect()
    assert [r.value for r in got] == [x.rstrip("\r") for x in lines if x]
    assert got[0].at == 1


def test_syslog_stream_goes_on_where_it_stopped(spark, tmp_path):
    plugins.register(spark)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()

    def run():
        stream = spark.readStream.format("syslog").option("rangeBytes", 5).load(str(folder))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.value for r in spark.read.parquet(out).collect())

    (folder / "a.log").write_text("one\ntwo\nthr")
    assert run() == ["one", "two"]
    with open(folder / "a.log", "a") as f:
        f.write("ee\n")
    (folder / "b.log").write_text("four\n")
    assert run() == ["four", "one", "three", "two"]
    assert run() == ["four", "one", "three", "two"]
    empty = tmp_path / "none"
    empty.mkdir()
    assert streams.run_to_end(spark.readStream.format("syslog").load(str(empty))).count() == 0
