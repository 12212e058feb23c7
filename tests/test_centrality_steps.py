"""Steps of centralities are worked out once each."""

from __future__ import annotations

from duskwatch.operators import centrality


def test_plans_do_not_grow_with_steps(spark, monkeypatch):
    leaves = []
    for name in ("stored", "stored_by"):
        if write := getattr(centrality, name, None):
            size = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
            monkeypatch.setattr(centrality, name, lambda df, *a, write=write, **b: leaves.append(size(df)) or write(df, *a, **b))
    nodes = spark.range(30).selectExpr("id % 3 AS g", "id AS node").localCheckpoint()
    edges = nodes.selectExpr("g", "node AS src", "node + 3 AS dst").filter("dst < 30").localCheckpoint()
    for run in (centrality.pagerank, centrality.eigenvector):
        assert run(nodes, edges, "g", steps=4, tolerance=0.0).count() == 30
    assert max(leaves) <= 6


def test_settled_graphs_stop_early(spark, monkeypatch):
    written, write = [], centrality.stored_by
    monkeypatch.setattr(centrality, "stored_by", lambda *a, **b: written.append(a[1]) or write(*a, **b))
    ring = spark.range(6).selectExpr("1 AS g", "id AS node"), spark.range(6).selectExpr("1 AS g", "id AS src", "(id + 1) % 6 AS dst")
    assert {round(r.rank, 9) for r in centrality.pagerank(*ring, "g").collect()} == {round(1 / 6, 9)}
    assert written.count("ranks") == 1 + centrality.UNROLLED
