"""Edges and triangles of graphs are worked out once, not for every feature that reads them."""

from __future__ import annotations

from duskwatch.operators import graphs


def test_features_read_stored_edges(spark):
    rows = [(g, i, "persistence" if i % 3 else "discovery", i * 60, i % 2) for g in ("a", "b") for i in range(8)]
    events = spark.createDataFrame(rows, "g string, node long, action string, t long, actor long").selectExpr("g", "node", "action", "timestamp_seconds(t) ts", "actor")
    nodes, edges = graphs.behaviour_graph(events, "g", "node", "action", "ts", "actor")
    features = graphs.graph_features(nodes, edges, "g")
    assert features._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 2  # the gaps between events
    # of 8 events 7 edges to the next and 6 to the next of the actor: 6 triangles, 5 inner edges in two of them
    assert [(r.node_count, r.edge_count, r.triangles, r.squares) for r in features.collect()] == [(8.0, 13.0, 6.0, 5.0)] * 2
    found = {r.node: (r.out_degree, r.in_degree, r.degree) for r in graphs.degrees(edges.filter("g = 'a'"), "g").collect()}
    assert found[0] == (2, 0, 2) and found[7] == (0, 2, 2) and found[4] == (2, 2, 4)
