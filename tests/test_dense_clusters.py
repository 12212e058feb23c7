"""Density clusters where many rows are near each other and blocks are small."""

from __future__ import annotations

import numpy as np

from duskwatch.operators import clusters

from .test_clusters_matching import plain_dbscan


def test_blocks_agree_with_plain_search(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 30)
    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(6)[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(140)] + [(200, [0.0] * 6), (201, None), (202, [3.0] * 6), (203, [6.0] * 6)]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    for eps, least in ((0.01, 2), (0.04, 3), (0.1, 5), (1.2, 3), (2.0, 3)):
        assert {r.id: r.cluster for r in clusters.dbscan(table, "id", "v", eps, least, 5).collect()} == plain_dbscan(rows, eps, least), (eps, least)


def test_links_grow_with_rows_not_with_near_pairs(spark):
    rng = np.random.default_rng(9)
    vectors = np.ones(8) + rng.normal(size=(400, 8)) * 0.01
    table = spark.createDataFrame([(i, v.tolist(), i != 7) for i, v in enumerate(vectors)], "node long, v array<double>, core boolean")
    links = clusters.core_links(table, 400, 0.5, vectors[:4]).collect()
    assert len(links) == 399 and [(r.a, r.b) for r in links if not r.inner] == [(7, min(r.b for r in links))]


def test_near_rows_on_the_edge():
    x = np.eye(3)
    y = np.array([[1.0, np.sqrt(3), 0.0], [1.0, 2.0, 0.0]])
    found = {(int(i), int(j)) for a, b in clusters.near_rows(x, y, 0.5, x[:1]) for i, j in zip(a, b)}
    assert found == {(0, 0), (1, 0), (1, 1)}
