"""Component measures of graphs beyond the bound of the path measures, and nearest rows handed on by tasks."""

from __future__ import annotations

import numpy as np

from duskwatch.operators import paths, similarity


def test_component_measures_of_large_graphs(spark):
    line = [("line", i, i + 1) for i in range(1200)]
    star = [("star", 0, i) for i in range(1, 1500)] + [("star", 5, 5), ("star", 3, 4)]
    two = [("two", 1, 2), ("two", 3, 4)]
    edges = spark.createDataFrame(line + star + two, "g string, src long, dst long")
    nodes = edges.selectExpr("g", "explode(array(src, dst)) AS node").distinct().union(spark.createDataFrame([("one", 7), ("two", 9)], "g string, node long"))
    got = {r.g: tuple(r)[1:] for r in paths.component_measures(nodes, edges, "g").collect()}
    assert got == {"line": (1, 1201, 1200, 600), "star": (1, 1500, 2, 1), "two": (3, 2, 0, 0), "one": (1, 1, 0, 0)}


def test_component_measures_equal_path_measures(spark):
    rng = np.random.default_rng(5)
    edges = [(f"g{g}", int(a), int(b)) for g in range(6) for a, b in rng.integers(0, 9, size=(5 + 3 * g, 2))]
    nodes = spark.createDataFrame([(f"g{g}", i, "x") for g in range(6) for i in range(9)], "g string, node long, action string")
    edges = spark.createDataFrame(edges, "g string, src long, dst long")
    names = ("g", "components", "largest_component", "diameter", "radius")
    assert sorted(paths.component_measures(nodes, edges, "g").collect()) == sorted(paths.path_measures(nodes, edges, "g").select(*names).collect())


def test_tasks_hand_on_few_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(4000)] + [(4000 + i, [1.0] * 8) for i in range(50)]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(2)
    found = similarity.near_enough(table, table.filter("id % 50 = 0"), "id", "v", 5, slack=1e-9).cache()
    assert found.filter("query < 4000").count() < 80 * 400
    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    held = {}
    for r in found.collect():
        held.setdefault(r.query, set()).add(r.id)
    for q in range(0, 4050, 50):
        far = 1 - x @ x[q]
        far[q] = np.inf
        assert set(np.flatnonzero(far <= np.sort(far)[4] + 5e-10).tolist()) <= held[q]
