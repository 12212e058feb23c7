"""Behaviour graphs: nodes and edges as tables, features per graph by grouping and joins, embeddings per feature vector.

All events of a graph count, however many there are. Only the last step, from one feature vector to one embedding,
runs in numpy, on vectors of fixed size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from duskwatch.functions.vectors import min_max

from .steps import stored
from .windows import ESCALATIONS, consecutive, gap_statistics

MAX_NODES = 1000
WIDTH = 64
FEATURES = (
    "node_count edge_count density clustering degree_mean degree_max degree_var triangles squares event_rate mean_gap max_gap var_gap mean_change bursts quiet "
    "persistence escalation out_degree_mean centrality_max centrality_mean"
).split()
# Actions that raise a node's importance, and by how much; the same for unusual ones.
RISKY_ACTIONS, RISKY_BONUS, UNUSUAL_BONUS = ("privilege_escalation", "persistence", "exfiltration", "impact"), 10.0, 5.0
# The first steps of an attack, whose direct succession scores.
ESCALATION_STEPS = ESCALATIONS[:3]


def behaviour_graph(events: DataFrame, by: str, node: str, action: str, ts: str, actor: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (by, node, action, ts) and edges (by, src, dst, kind): each event to the next of its graph, and to the next of its actor.

    An edge that is both is one edge of kind causal. Edges go forward in time, so there are no cycles. Events without a
    time come first.
    """
    nodes = events.select(by, F.col(node).alias("node"), F.col(action).alias("action"), F.col(ts).alias("ts"), *([F.col(actor).alias("actor")] if actor else []))
    edges = consecutive(nodes, [by], ["ts", "node"], "node", "ts").select(by, "src", "dst", F.lit("temporal").alias("kind"))
    if actor:
        causal = consecutive(nodes, [by, "actor"], ["ts", "node"], "node", "ts").select(by, "src", "dst", F.lit("causal").alias("kind"))
        edges = simple_edges(edges.unionByName(causal), by)
    return nodes, edges


def simple_edges(edges: DataFrame, by: str) -> DataFrame:
    """Parallel edges as one; causal wins."""
    return edges.groupBy(by, "src", "dst").agg(F.min("kind").alias("kind"))


def degrees(edges: DataFrame, by: str) -> DataFrame:
    """Per graph and node: out, in and total degree."""
    end = lambda side: F.struct(F.col(side).alias("node"), F.lit(int(side == "src")).alias("out"), F.lit(int(side == "dst")).alias("into"))
    ends = edges.select(by, F.explode(F.array(end("src"), end("dst"))).alias("e")).groupBy(by, F.col("e.node").alias("node"))
    return ends.agg(F.sum("e.out").alias("out_degree"), F.sum("e.into").alias("in_degree"), F.count("*").alias("degree"))


def importance(nodes: DataFrame, edges: DataFrame, by: str, unusual: Column | None = None) -> DataFrame:
    """Nodes with their importance: degree, and bonuses for risky actions and for rows that ``unusual`` picks."""
    degree = degrees(edges, by).select(by, "node", "degree")
    bonus = F.when(F.col("action").isin(*RISKY_ACTIONS), F.lit(RISKY_BONUS)).otherwise(F.lit(0.0))
    bonus = bonus + F.when(unusual, F.lit(UNUSUAL_BONUS)).otherwise(F.lit(0.0)) if unusual is not None else bonus
    return nodes.join(degree, [by, "node"], "left").withColumn("importance", F.coalesce("degree", F.lit(0)) + bonus).drop("degree")


def prune(nodes: DataFrame, edges: DataFrame, by: str, most: int = MAX_NODES, unusual: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The ``most`` most important nodes of each graph, ties by node, and the edges among them."""
    w = Window.partitionBy(by).orderBy(F.desc("importance"), "node")
    kept = importance(nodes, edges, by, unusual).withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn")
    keys = kept.select(by, "node")
    inner = edges.join(keys.withColumnRenamed("node", "src"), [by, "src"], "left_semi").join(keys.withColumnRenamed("node", "dst"), [by, "dst"], "left_semi")
    return kept, inner


def _triangle_rows(edges: DataFrame, by: str) -> DataFrame:
    """(by, a, b, c) of each triangle. Edges are turned from the node with fewer neighbours, ties by node: so a hub, where many end, starts few."""
    e = edges.select(by, F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).filter("x <> y").distinct()
    around = e.select(by, F.explode(F.array("x", "y")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("n"))
    of = lambda side: around.select(by, F.col("node").alias(side), F.struct("n", "node").alias(f"{side}_at"))
    ranked = e.join(of("x"), [by, "x"]).join(of("y"), [by, "y"])
    e = stored(ranked.select(by, F.least("x_at", "y_at")["node"].alias("a"), F.greatest("x_at", "y_at")["node"].alias("b")), "turned")
    f, g = e.select(by, F.col("a").alias("b"), F.col("b").alias("c")), e.select(by, "a", F.col("b").alias("c"))
    return e.join(f, [by, "b"]).join(g, [by, "a", "c"]).select(by, "a", "b", "c")


def triangles(edges: DataFrame, by: str) -> DataFrame:
    """Triangles of each undirected graph: turned edges are joined twice."""
    return _triangle_rows(edges, by).groupBy(by).agg(F.count("*").alias("triangles"))


def squares(edges: DataFrame, by: str, found: DataFrame | None = None) -> DataFrame:
    """Of each graph the pairs of common neighbours of the ends of an edge, summed over its undirected edges.

    ``found`` are the triangles, if they are known.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    common = (_triangle_rows(edges, by) if found is None else found).select(by, F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("edge")).groupBy(by, "edge").agg(F.count("*").alias("n"))
    return common.groupBy(by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("squares"))


def clustering(nodes: DataFrame, edges: DataFrame, by: str, found: DataFrame | None = None) -> DataFrame:
    """Mean local clustering of each graph; nodes with fewer than two neighbours count as 0. ``found`` are the triangles, if they are known."""
    around = edges.filter("src <> dst").select(by, F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("e"))
    size = around.select(by, "e.node", "e.other").distinct().groupBy(by, "node").agg(F.count("*").alias("k"))
    held = (_triangle_rows(edges, by) if found is None else found).select(by, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(by, "node").agg(F.count("*").alias("t"))
    local = held.join(size, [by, "node"]).groupBy(by).agg(F.sum(2 * F.col("t") / (F.col("k") * (F.col("k") - 1))).alias("total"))
    return nodes.groupBy(by).agg(F.count("*").alias("n")).join(local, by, "left").select(by, (F.coalesce("total", F.lit(0.0)) / F.col("n")).alias("clustering"))


def escalations(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Of each graph 2 for every edge from one step of an attack to the next."""
    end = lambda side: nodes.select(by, F.col("node").alias(side), F.col("action").alias(f"{side}_action"))
    steps = F.lit(False)
    for x, y in ESCALATION_STEPS:
        steps = steps | ((F.col("src_action") == x) & (F.col("dst_action") == y))
    return edges.join(end("src"), [by, "src"]).join(end("dst"), [by, "dst"]).filter(steps).groupBy(by).agg(F.sum(F.lit(2.0)).alias("escalation"))


def graph_features(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """One row per graph with the named features; what a graph lacks is 0. Edges and triangles are read by several features, so they are stored."""
    edges = stored(edges, "edges")
    found = stored(_triangle_rows(edges, by), "triangles")
    per_node = nodes.join(degrees(edges, by), [by, "node"], "left").fillna(0, ["degree", "out_degree", "in_degree"])
    n = F.col("node_count")
    base = per_node.groupBy(by).agg(
        F.count("*").alias("node_count"), (F.sum("degree") / 2).alias("edge_count"), F.avg("degree").alias("degree_mean"), F.max("degree").cast("double").alias("degree_max"),
        F.var_pop("degree").alias("degree_var"), F.avg("out_degree").alias("out_degree_mean"), F.sum(F.when(F.col("action") == "persistence", 1 + 0.1 * F.col("out_degree")).otherwise(0.0)).alias("persistence"),
        ((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))) / 1e6).alias("span"),
    )
    timing = gap_statistics(nodes, [by], ["ts", "node"], "ts").drop("n_events")
    out = base
    for part in (timing, found.groupBy(by).agg(F.count("*").alias("triangles")), squares(edges, by, found), clustering(nodes, edges, by, found), escalations(nodes, edges, by)):
        out = out.join(part, by, "left")
    several = n > 1
    out = out.withColumns({
        "density": F.when(several, F.col("edge_count") / (n * (n - 1))), "event_rate": n / F.greatest(F.col("span"), F.lit(1.0)),
        "centrality_max": F.when(several, F.col("degree_max") / (n - 1)), "centrality_mean": F.when(several, F.col("degree_mean") / (n - 1)),
    })
    return out.select(by, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def feature_vector(features: DataFrame, by: str, width: int = WIDTH) -> DataFrame:
    """(by, n_nodes, features): the named features, padded with zeros to ``width`` and scaled to 0..1 within the vector."""
    padded = F.concat(F.array(*FEATURES), F.array_repeat(F.lit(0.0), width - len(FEATURES)))
    return features.select(by, F.col("node_count").cast("long").alias("n_nodes"), min_max(padded).alias("features"))


def spectral_embeddings(features: np.ndarray) -> np.ndarray:
    """Unit vectors of 128 numbers, one for each row of features: two weighted eigenvectors of a Markov Laplacian over the
    first 32 features, and the features. All rows are decomposed together.

    The stationary distribution is the left eigenvector of the eigenvalue nearest 1. The sign of an eigenvector is fixed by its
    largest component; of equal eigenvalues the order is the library's.
    """
    x = features[:, :32]
    p = np.exp(-2 * (x[:, :, None] - x[:, None]) ** 2)
    p /= p.sum(2, keepdims=True)
    for _ in range(10):
        p /= p.sum(2, keepdims=True)
        p /= p.sum(1, keepdims=True)
    flipped = p.transpose(0, 2, 1)
    values, vectors = np.linalg.eig(flipped)
    nearest = np.abs(values - 1).argmin(1)
    d = np.abs(np.real(np.take_along_axis(vectors, nearest[:, None, None], 2)[:, :, 0]))
    d = d / d.sum(1, keepdims=True) + 1e-10
    laplacian = (d[:, :, None] * np.eye(x.shape[1]) - (p + flipped) / 2) / np.sqrt(d[:, :, None] * d[:, None])
    laplacian = (laplacian + laplacian.transpose(0, 2, 1)) / 2 + 1e-7 * np.eye(x.shape[1])
    values, vectors = np.linalg.eigh(laplacian)
    order = np.abs(values).argsort(axis=1, kind="stable")[:, :2]
    v = np.take_along_axis(vectors, order[:, None], 2) * np.sqrt(np.abs(np.take_along_axis(values, order, 1)) + 1e-10)[:, None]
    largest = np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1)
    v = np.where(largest < 0, -v, v)
    whole = np.concatenate([v[:, :, 0], v[:, :, 1], features], axis=1)
    size = np.linalg.norm(whole, axis=1, keepdims=True)
    return np.where(size > 0, whole / np.where(size > 0, size, 1), 1 / np.sqrt(whole.shape[1]))


@F.pandas_udf(ArrayType(DoubleType()))
def spectral(features: pd.Series) -> pd.Series:
    if not len(features):
        return pd.Series([], dtype=object)
    rows = np.stack(features.to_numpy())
    return pd.Series([v for at in range(0, len(rows), 1024) for v in spectral_embeddings(rows[at : at + 1024])])


def embed_graphs(events: DataFrame, by: str, node: str, action: str, ts: str, actor: str | None = None) -> DataFrame:
    """(graph, n_nodes, features, embedding) of each graph of events."""
    nodes, edges = behaviour_graph(events, by, node, action, ts, actor)
    vectors = feature_vector(graph_features(nodes, edges, by), by)
    return vectors.select(F.col(by).cast("string").alias("graph"), "n_nodes", "features", spectral("features").alias("embedding"))
