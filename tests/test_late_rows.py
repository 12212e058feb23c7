"""Late rows are told apart across a restart of the stream."""

from __future__ import annotations

import pytest

from duskwatch.streaming import streams


@pytest.mark.parametrize("kept", [True, False])
def test_late_rows_after_a_restart(spark, tmp_path, kept):
    schema = "id int, ts timestamp_ntz"
    state = str(tmp_path / "state") if kept else None
    seen: list = []

    def run(name, *rows):
        spark.createDataFrame(list(rows), "id int, t string").selectExpr("id", "cast(t as timestamp_ntz) as ts").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        sink = lambda ok, late, n: seen.append((n, sorted(r.id for r in ok.collect()), sorted(r.id for r in late.collect())))
        writer = streams.split_late(stream, "ts", "30 seconds", sink, state)
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    run("a", (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:00"), (3, None))
    run("b", (4, "2024-01-01 00:09:30"), (5, "2024-01-01 00:09:29"), (6, None))
    run("c", (7, None))
    run("d", (8, "2024-01-01 00:00:01"))
    assert seen[0] == (0, [1, 2, 3], [])
    assert seen[1:] == ([(1, [4, 6], [5]), (2, [7], []), (3, [], [8])] if kept else [(1, [4, 5, 6], []), (2, [7], []), (3, [8], [])])
