"""Expressions on edge rows, and streams against batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duskwatch.functions import net, scoring, text
from duskwatch.functions import vectors as V
from duskwatch.functions.stats import nearest_rank
from duskwatch.operators import clusters, graphs, learning, similarity, windows
from duskwatch.streaming import streams

from .plain import spectral_embedding


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_addresses(spark):
    values = ["10.0.0.1", "8.8.8.8", "8.8.8.8:53", "172.32.0.1", "127.0.0.1", "300.1.1.1", "", None, "::1"]
    assert column(spark, values, net.is_private) == [True, False, False, False, True, True, True, True, True]
    assert column(spark, values, net.ip_class)[:5] == ["PRIVATE/LAN", "PUBLIC/INTERNET", "PUBLIC/INTERNET", "PUBLIC/INTERNET", "LOOPBACK"]
    assert column(spark, ["0", "65535", "65536", "-1", "x", None], net.valid_port) == [True, True, False, False, False, False]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "x int")
    assert df.agg(nearest_rank("x", 0.5)).first()[0] == 3 and df.filter("x > 9").agg(nearest_rank("x", 0.5)).first()[0] is None


def test_text(spark):
    assert column(spark, ["aabb", "", None, "a"], text.entropy) == [1.0, 0.0, 0.0, 0.0]
    assert column(spark, ['["a","b"]', '"x"', "y", "", None], text.json_list) == [["a", "b"], ["x"], ["y"], [], []]
    hidden = column(spark, ["mail me@x.org now", "Bearer abc.def-ghi_jklmno", "ssn 123-45-6789", "card 4111 1111 1111 1111", None], text.redact)
    assert hidden == ["mail [REDACTED_EMAIL] now", "Bearer [REDACTED_TOKEN]", "ssn [REDACTED_SSN]", "card [REDACTED_CC]", None]
    times = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "1704164645", "1704164645000", "never", None], text.parse_time)
    assert len({t for t in times[:4]}) == 1 and times[4:] == [None, None]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b")), V.manhattan(F.col("a"), F.col("b")), V.mapped_cosine(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, pytest.approx(2**0.5), 2.0, 0.5), (0.0, pytest.approx(2**0.5), 2.0, 0.0), (1.0, 0.0, 0.0, 1.0)]
    same = spark.createDataFrame([([1.0] * 128,)], "a array<double>").select(V.bsf(F.col("a"), F.col("a"))).first()[0]
    assert same == pytest.approx(1.0)


def test_scores(spark):
    df = spark.createDataFrame([(0.9, 0.95, 0.4, "APT"), (0.9, 0.95, 0.4, "Benign"), (0.0, 0.0, 0.0, "Other")], "s double, n double, c double, t string")
    no = F.lit(False)
    risks = [r[0] for r in df.select(scoring.risk(F.col("s"), F.col("n"), F.col("c"), F.col("t"), no, no)).collect()]
    base = (0.3 * 0.9 + 0.4 * 0.95 + 0.3 * 0.4) * 1.2
    assert risks == [pytest.approx(min(1.0, base * (1 + 0.25 * 0.75) * (1 - 0.25 * 0.1))), pytest.approx(0.15), pytest.approx(0.5 * (1 - 0.125))]
    few = df.select(scoring.confidence(F.lit(0.1), F.lit(0.9), F.lit(0), F.lit(3), F.lit(1.0))).first()[0]
    assert few == 0.5


def test_outlier_factor():
    rng = np.random.default_rng(0)
    assert similarity.local_outlier_factor(np.vstack([[8.0, 8.0], rng.normal(size=(5, 2)) * 0.1]), 2)[0] > 3


def test_dbscan(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (np.eye(4)[i // 10] + rng.normal(size=4) * 0.01).tolist()) for i in range(30)] + [(99, [1.0, 1.0, 1.0, 1.0])]
    got = dict(map(tuple, clusters.dbscan(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.15, 3).collect()))
    assert [got[i] for i in (0, 9, 10, 19, 20, 29, 99)] == [0, 0, 10, 10, 20, 20, None]


def test_graph_features(spark):
    events = spark.createDataFrame([("g", 1, "execution", 0.0, 7), ("g", 2, "persistence", 2.0, 8), ("g", 3, "execution", 400.0, 7), ("h", 4, "x", 5.0, 1)], "g string, id long, action string, s double, pid long")
    events = events.withColumn("ts", F.timestamp_seconds("s"))
    f = {r["g"]: r for r in graphs.graph_features(*graphs.behaviour_graph(events, "g", "id", "action", "ts", "pid"), "g").collect()}
    assert (f["g"].node_count, f["g"].edge_count, f["g"].triangles, f["g"].clustering, f["g"].persistence) == (3, 3, 1, 1, 1.1)
    assert (f["h"].node_count, f["h"].edge_count, f["h"].density, f["h"].mean_gap) == (1, 0, 0, 0)
    for r in graphs.embed_graphs(events, "g", "id", "action", "ts", "pid").collect():
        assert len(r.features) == graphs.WIDTH and min(r.features) == 0 and max(r.features) == 1
        assert len(r.embedding) == 96 + 32 and np.linalg.norm(r.embedding) == pytest.approx(1)
        assert r.embedding == pytest.approx(spectral_embedding(np.array(r.features)).tolist())
    assert graphs.embed_graphs(events.limit(0), "g", "id", "action", "ts").count() == 0


def test_embeddings_of_many_graphs_at_once():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.random((40, graphs.WIDTH)), np.zeros((1, graphs.WIDTH)), np.ones((1, graphs.WIDTH))])
    got = graphs.spectral_embeddings(rows)
    assert got.shape == (42, 64 + graphs.WIDTH)
    for i in range(40):
        assert got[i] == pytest.approx(spectral_embedding(rows[i]), abs=1e-9)
    assert np.allclose(np.linalg.norm(got, axis=1), 1)


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_weights_folded_in_chunks_equal_a_replay(spark, chunk):
    rng = np.random.default_rng(chunk)
    kinds = [*learning.FACTORS, None, "other"]
    rows = [(["a", "a", "a", "b", None][int(k)], i, kinds[int(t)]) for i, (k, t) in enumerate(zip(rng.integers(0, 5, 400), rng.integers(0, 5, 400)))] + [("once", 0, "false_negative")]
    want: dict = {}
    for key, _, kind in rows:
        want[key] = max(0.5, min(2.0, want.get(key, 1.0) * learning.FACTORS.get(kind, 1.0)))
    df = spark.createDataFrame(rows, "k string, at int, kind string").repartition(5)
    got = {r.k: r.weight for r in learning.adjusted_weights(df, "k", "kind", ["at"], chunk).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(w, abs=1e-12) for k, w in want.items())
    assert learning.adjusted_weights(df.limit(0), "k", "kind", ["at"]).count() == 0


def test_dedupe_window(spark):
    df = spark.sql("select 'k' as k, timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, s) as ts, id from (select explode(array(0, 2, 4, 6, 20)) as s, 1 as id)")
    got = sorted((r.first_ts.second, r.repeats) for r in windows.dedupe_within(df, ["k"], "ts", ["id"], 5).collect())
    assert got == [(0, 3), (6, 1), (20, 1)]


def test_evaluation(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    got = {r["class"]: r for r in learning.evaluation(df, "t", "p").collect()}
    assert got[1].precision == pytest.approx(1 / 3) and got[1].recall == 1 and got[2].f1 == 0 and got[0].accuracy == 0.5


def test_late_rows_go_apart(spark, tmp_path):
    for i, seconds in enumerate(([100, 110], [20, 112])):
        spark.createDataFrame([(s,) for s in seconds], "s long").select(F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    got = []
    for i in range(2):
        got.append(spark.read.parquet(str(tmp_path / f"in/{i}")))
    seen: list = []
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    writer = streams.split_late(stream, "ts", "30 seconds", lambda ok, late, n: seen.append((ok.count(), late.count())))
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(a + b for a, b in seen) == 4
