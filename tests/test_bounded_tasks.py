"""What one task sorts, reads and holds doesn't grow with the tables."""

from __future__ import annotations

import numpy as np

from duskwatch.operators import investigations as I
from duskwatch.operators import similarity
from duskwatch.sources import plugins


def test_ids_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS_A_PART", 5)
    asked = spark.createDataFrame([(str(i),) for i in (*range(100), 3, 3)] + [(None,)], "id string")
    first = spark.createDataFrame([(3, "x"), (3, "y"), (None, "n")], "id long, a string")
    second = spark.createDataFrame([(3, "z"), (7, "z"), (7, "z")], "id long, a string")
    found = I.by_id(asked, "id", ("one", first), ("two", second))
    assert "hashpartitioning(id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 21)" in plan
    rows = sorted((r.id, r.origin, r.record) for r in found.collect() if r.origin)
    assert rows == [("3", "one", '{"id":3,"a":"x"}'), ("3", "one", '{"id":3,"a":"y"}'), ("7", "two", '{"id":7,"a":"z"}'), ("7", "two", '{"id":7,"a":"z"}')]
    assert found.count() == 103


def test_a_range_of_lines_lists_no_folder_and_gives_batches(tmp_path, monkeypatch):
    text = "".join(f"line {i} é\r\n\n" for i in range(400)).encode() + b"\xff\xfelast"
    (tmp_path / "a.log").write_bytes(text)
    ranges = plugins._ranges({str(tmp_path / "a.log"): (0, len(text))}, 777)
    monkeypatch.setattr(plugins, "_files", None)
    got = [r for part in ranges for b in plugins._lines(str(tmp_path), part) for r in b.to_pylist()]
    assert [r["value"] for r in got] == [f"line {i} é" for i in range(400)] + ["last"]
    assert all(text[r["at"] :].startswith(r["value"][:5].encode()) for r in got[:-1]) and {r["file"] for r in got} == {str(tmp_path / "a.log")}


def test_lines_are_read_once(spark):
    from duskwatch.sources.readers import syslog_events

    lines = spark.createDataFrame([('<1> x: {"type": "Cowrie", "input": "wget http://a", "timestamp": "2024-01-01 00:00:00"}',), ("plain {",), (None,)], "value string")
    found = syslog_events(lines)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.event_type, r.command, r.severity, r.source_mode, r.sensor) for r in found.filter("command is not null").collect())
    assert got == [("process", "wget http://a", "CRITICAL", "TPOT", "cowrie"), ("syslog", "plain {", None, "TPOT", None)] and found.count() == 3


def test_pairs_are_handed_on_in_small_batches():
    kept = np.arange(40).reshape(10, 4) % 3 > 0
    pieces = list(similarity._kept_pairs(kept, 8))
    assert len(pieces) == 5 and max(len(i) for i, _ in pieces) <= 8
    assert [(a, b) for i, j in pieces for a, b in zip(i, j)] == list(zip(*np.nonzero(kept)))


def test_patterns_without_an_id_fill_many_documents(spark, tmp_path):
    from pyspark.sql import functions as F

    from duskwatch.sources import documents

    rows = spark.range(200).select(F.lit("").alias("pattern_id"), F.lit("APT").alias("threat_class"), F.array(F.col("id").cast("double")).alias("embedding"))
    documents.write_patterns(rows, str(tmp_path / "k"), 20)
    assert len(list((tmp_path / "k").glob("document=*"))) > 5
    good, bad = documents.read_patterns(spark, str(tmp_path / "k"), 1)
    assert good.count() == 0 and bad.filter("error = 'no pattern_id'").count() == 200
