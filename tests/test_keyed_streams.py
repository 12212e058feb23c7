"""Keyed streams that stop and go on must give what one pass over all rows gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from duskwatch.streaming import keyed, streams


@pytest.fixture(scope="module")
def events():
    rng, start, rows = random.Random(7), datetime(2024, 1, 1), []
    at = start
    for i in range(300):
        at += timedelta(milliseconds=rng.choice([0, 200, 900, 4000, 7000]))
        rows.append((i, rng.choice(["a", "b", "c"]), at))
    return rows


def kept(events, seconds):
    last, out = {}, []
    for i, key, at in sorted(events, key=lambda r: (r[2], r[0])):
        if key not in last or at >= last[key] + timedelta(seconds=seconds):
            last[key] = at
            out.append((key, i))
    return sorted(out)


def go_on(spark, folder, build, mode):
    """Run what has come so far to its end, from the checkpoint of the last run."""
    schema = "event_id long, kind string, ts timestamp"
    found = []
    query = build(streams.file_stream(spark, f"{folder}/in", schema)).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
    query.foreachBatch(lambda batch, number: found.extend(tuple(r) for r in batch.collect())).trigger(availableNow=True).start().awaitTermination()
    return found


def test_first_sights_survive_a_restart(spark, events, tmp_path):
    build = lambda s: keyed.first_sights(s, "kind", "ts", "event_id", 5, "1 hour")
    out = []
    for part in (events[:90], events[90:91], events[91:230], events[230:]):
        spark.createDataFrame(part, "event_id long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out += [r[:2] for r in go_on(spark, tmp_path, build, "append")]
    assert sorted(out) == kept(events, 5)
    whole = spark.createDataFrame([*events, (999, "a", None)], "event_id long, kind string, ts timestamp")
    whole.coalesce(1).write.parquet(f"{tmp_path}/whole/in")
    assert sorted(r[:2] for r in go_on(spark, f"{tmp_path}/whole", build, "append")) == kept(events, 5)


def test_newest_survive_a_restart(spark, events, tmp_path):
    held = {}
    for part in (events[:150], events[150:]):
        spark.createDataFrame(part, "event_id long, kind string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = go_on(spark, tmp_path, lambda s: keyed.newest(s, "kind", "ts", "event_id", 7), "update")
        for key in {r[0] for r in rows}:
            held[key] = [r[2] for r in sorted(r for r in rows if r[0] == key)]
    for key in "abc":
        assert held[key] == [i for i, k, at in sorted(events, key=lambda r: (-r[2].timestamp(), r[0])) if k == key][:7]


def test_freshness(spark):
    rows = spark.createDataFrame([("a", 1_000_000_000), ("a", 5), ("b", 99_999_999), ("c", 100_000_000)], "key string, at long")
    assert dict(map(tuple, keyed.freshness(rows, 1_000_000_000).collect())) == {"a": True, "b": False, "c": False}
