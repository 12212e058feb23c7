"""Small files are written by many tasks, and into one folder where their path says nothing."""

from __future__ import annotations

import os

from duskwatch.plans.reader_queries import write_apart, write_each


def test_a_file_for_each_row(spark, tmp_path):
    lines = spark.range(60).selectExpr("id AS k", "concat('line', id) AS value")
    flat, keyed = str(tmp_path / "flat"), str(tmp_path / "keyed")
    write_apart(lines.select("value"), flat)
    write_each(lines, keyed)
    files = [f for f in os.listdir(flat) if f.endswith(".txt")]
    assert len(files) == 60 and not any(os.path.isdir(os.path.join(flat, f)) for f in os.listdir(flat))
    assert {r.value for r in spark.read.text(flat).collect()} == {f"line{i}" for i in range(60)}
    parts = {f.split("-")[1] for _, _, names in os.walk(keyed) for f in names if f.endswith(".txt")}
    assert len(parts) > 4
