"""Measures of graphs of any size by passing messages along edges: all graphs at once, one join and one sum a step.

Edges lie in buckets of their start and the state in buckets of the node, so a step shuffles only the sums that go to
each node, partial ones at first. The state is written every step, as the next one reads it more than once: no plan grows
with the steps and lost executors cost little. Numbers of a graph are few rows and are broadcast, unless there are more
than ``FEW`` graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .steps import stored, stored_by

#: Steps between two looks at how far the state moved.
UNROLLED = 4
#: Graphs whose numbers are broadcast.
FEW = 100_000


def _different(nodes: DataFrame, edges: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Different nodes, and different edges without loops."""
    return nodes.select(by, "node").distinct(), edges.select(by, "src", "dst").filter("src <> dst").distinct()


def _ends(nodes: DataFrame, edges: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    n, e = _different(nodes, edges, by)
    return stored(n, "nodes"), stored(e, "edges")


def _per_graph(sizes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return F.broadcast if sizes.limit(FEW + 1).count() <= FEW else lambda df: df


def _got(state: DataFrame, e: DataFrame, by: str, sent: str) -> DataFrame:
    """(by, node, got): what each node is sent; ``e`` and ``state`` lie in the same buckets."""
    # merged, as files of few MB that hold a million nodes would be broadcast
    out = e.join(state.select(by, F.col("node").alias("src"), F.col(sent).alias("sent")).hint("merge"), [by, "src"])
    return out.groupBy(by, F.col("dst").alias("node")).agg(F.sum("sent").alias("got"))


def pagerank(nodes: DataFrame, edges: DataFrame, by: str, damping: float = 0.85, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(by, node, rank): share of a walk that follows edges and starts anew with 1 - ``damping``; ends hand on to all nodes.

    Stops after ``steps``, or when in no graph the ranks of n nodes together move by more than n x ``tolerance``.
    """
    n, e = _different(nodes, edges, by)
    e, n = stored_by(e, "edges", by, "src"), stored_by(n, "nodes", by, "node")
    sizes = stored(n.groupBy(by).agg(F.count("*").alias("size")), "sizes")
    few = _per_graph(sizes)
    out = e.groupBy(by, F.col("src").alias("node")).agg(F.count("*").alias("out"))
    state = n.join(out, [by, "node"], "left").join(few(sizes), by)
    state = stored_by(state.select(by, "node", "size", F.coalesce("out", F.lit(0)).alias("out"), (1.0 / F.col("size")).alias("rank"), F.lit(0.0).alias("before")), "ranks", by, "node", deal=False)
    for done in range(1, steps + 1):
        got = _got(state.filter("out > 0").withColumn("part", F.col("rank") / F.col("out")), e, by, "part")
        loose = state.groupBy(by).agg(F.sum(F.when(F.col("out") == 0, F.col("rank")).otherwise(0.0)).alias("loose"))
        now = damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("size")) + (1 - damping) / F.col("size")
        state = state.join(got, [by, "node"], "left").join(few(loose), by).select(by, "node", "size", "out", now.alias("rank"), F.col("rank").alias("before"))
        state = stored_by(state, "ranks", by, "node", deal=False)
        if done % UNROLLED == 0 and done < steps and not _moves(state, by, "rank", tolerance):
            break
    return state.select(by, "node", "rank")


def _moves(state: DataFrame, by: str, what: str, tolerance: float) -> bool:
    """Whether in any graph the values of its nodes together moved far enough to go on."""
    if tolerance <= 0:
        return True
    moved = state.groupBy(by).agg(F.sum(F.abs(F.col(what) - F.col("before"))).alias("moved"), F.first("size").alias("size"))
    return not moved.filter(F.col("moved") >= F.col("size") * tolerance).isEmpty()


def eigenvector(nodes: DataFrame, edges: DataFrame, by: str, steps: int = 1000, tolerance: float = 1e-6) -> DataFrame:
    """(by, node, influence): what nodes get by adding that of their predecessors again and again, at length 1 in each graph.

    Graphs that have not settled after ``steps`` keep their last values.
    """
    n, e = _different(nodes, edges, by)
    e, n = stored_by(e, "edges", by, "src"), stored_by(n, "nodes", by, "node")
    sizes = stored(n.groupBy(by).agg(F.count("*").alias("size")), "sizes")
    few = _per_graph(sizes)
    # stored are the sums before they are brought to length 1, as the length is that of all nodes of a graph
    state = n.join(few(sizes), by).select(by, "node", "size", (1.0 / F.col("size")).alias("grown"), F.lit(0.0).alias("before"))
    state = stored_by(state, "influence", by, "node", deal=False)
    length = sizes.select(by, F.lit(1.0).alias("length"))
    scaled = lambda: state.join(few(length), by).select(by, "node", "size", (F.col("grown") / F.col("length")).alias("x"), "before")
    for done in range(1, steps + 1):
        x = scaled()
        grown = x.join(_got(x, e, by, "x"), [by, "node"], "left").select(by, "node", "size", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("grown"), F.col("x").alias("before"))
        state = stored_by(grown, "influence", by, "node", deal=False)
        length = stored(state.groupBy(by).agg(F.sqrt(F.sum(F.col("grown") * F.col("grown"))).alias("length")), "lengths")
        if done % UNROLLED == 0 and done < steps and not _moves(scaled(), by, "x", tolerance):
            break
    return scaled().select(by, "node", F.col("x").alias("influence"))


def components(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, node, component): the smallest node that edges lead to, whichever way they point.

    Each round a node takes the smallest label around it, then the label of its label; so labels travel twice as far
    every round.
    """
    n, e = _ends(nodes, edges, by)
    both = stored(e.unionByName(e.select(by, F.col("dst").alias("src"), F.col("src").alias("dst"))), "links")
    state = stored(n.select(by, "node", F.col("node").alias("label")), "labels")
    while True:
        offered = both.join(state.select(by, F.col("node").alias("src"), F.col("label").alias("offer")), [by, "src"]).groupBy(by, F.col("dst").alias("node")).agg(F.min("offer").alias("offer"))
        near = stored(state.join(offered, [by, "node"], "left").select(by, "node", F.least("label", F.coalesce("offer", "label")).alias("label"), F.col("label").alias("old")), "near")
        ends = near.select(by, F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = near.join(ends, [by, "label"], "left").select(by, "node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        state = stored(jumped, "labels")
        if state.filter("label <> old").isEmpty():
            return state.select(by, "node", F.col("label").alias("component"))
        state = state.drop("old")
