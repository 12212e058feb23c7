"""The nearest rows of every row against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from duskwatch.operators import clusters, neighbours
from duskwatch.plans import vector_queries


@pytest.mark.parametrize("block, tile, few", [(32_768, 512, 8), (30, 7, 1), (70, 16, 2)])
def test_nearest_of_all_equals_all_pairs(spark, monkeypatch, block, tile, few):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(neighbours, "TILE", tile)
    monkeypatch.setattr(neighbours, "FEW", few)
    rng = np.random.default_rng(5)
    vectors = [*rng.normal(size=(150, 6)), *np.repeat(rng.normal(size=(2, 6)), 40, axis=0), np.zeros(6), np.zeros(6)]
    rows = [(f"k{i:03}", v.tolist()) for i, v in enumerate(vectors)] + [("none", None), (None, vectors[0].tolist()), ("k003", vectors[9].tolist())]
    table = spark.createDataFrame(rows, "id string, v array<float>").repartition(3)
    got = {}
    for r in neighbours.nearest_of_all(table, "id", "v", 4).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((round(r.distance, 9) + 0.0, r.id))
    x = np.array([np.float32(v) for k, v in rows if k and v]).astype(float)
    names, size = [k for k, v in rows if k and v], np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    want = {}
    for q, own in zip(names, np.round(1 - np.clip(x @ x.T, -1, 1), 9) + 0.0):
        want.setdefault(q, []).extend((float(d), k) for d, k in zip(own, names) if k != q)
    assert got == {q: sorted(found)[:4] for q, found in want.items()}
    assert neighbours.nearest_of_all(table.limit(0), "id", "v", 4).count() == 0


def test_a_task_hands_on_few_rows_of_each(spark):
    rng = np.random.default_rng(6)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))] + [(900 + i, [1.0] * 8) for i in range(300)], "node long, v array<double>")
    for pair in clusters.meeting(table, 1200).applyInArrow(lambda t: neighbours._pair(t, "id", 5), "query long, id long, distance double").toPandas().groupby("query"):
        assert len(pair[1]) == 5


def test_every_vector_has_a_risk(spark):
    table = "/root/testdata/sf0.001"
    got = vector_queries.risk_scores(spark, table)
    assert sorted(r.vec_id for r in got.collect()) == sorted(r.vec_id for r in spark.read.parquet(f"{table}/embeddings.parquet").collect())
