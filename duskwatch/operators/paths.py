"""Path measures of behaviour graphs: distances, components, centralities, execution chains.

prune() bounds a graph to ``MAX_NODES`` nodes; so one graph is one bounded group, and its searches run from all of its
nodes at once in arrays. Components, diameter and radius have no bound; ``centrality`` has the measures that are joins over graphs of any size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centrality import components
from .graphs import MAX_NODES
from .steps import stored

# Actions that count as execution.
EXECUTION_ACTIONS = ("execution", "persistence", "privilege_escalation")
#: Distances that a task holds at once.
CELLS = 1 << 20
MEASURES = (
    "components largest_component diameter radius critical_path execution_chains betweenness_max betweenness_avg closeness_max closeness_avg "
    "pagerank_max pagerank_avg eigenvector_max eigenvector_avg"
).split()


class Adjacency:
    """Neighbours of each of ``n`` nodes, in rows."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(src, kind="stable")
        self.n, self.dst, self.size = n, dst[order], np.bincount(src, minlength=n)
        self.start = np.cumsum(self.size) - self.size

    def step(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``nodes``, neighbour) of every edge that leaves them."""
        size = self.size[nodes]
        owner = np.repeat(np.arange(len(nodes)), size)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return owner, self.dst[self.start[nodes][owner] + offset]


def searches(graph: Adjacency) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Breadth-first from every node: distances (-1: out of reach), numbers of shortest paths, and the edges of each level as (start, from, to)."""
    n = graph.n
    far, ways = np.full((n, n), -1, np.int32), np.zeros((n, n))
    start = node = np.arange(n)
    far[start, node], ways[start, node] = 0, 1
    levels, depth = [], 0
    while len(start):
        owner, to = graph.step(node)
        depth += 1
        begin, origin = start[owner], node[owner]
        held = (far[begin, to] < 0) | (far[begin, to] == depth)
        begin, origin, to = begin[held], origin[held], to[held]
        far[begin, to] = depth
        levels.append((begin, origin, to))
        np.add.at(ways, (begin, to), ways[begin, origin])
        start, node = np.divmod(np.unique(begin * n + to), n)
    return far, ways, levels


def betweenness(n: int, ways: np.ndarray, levels: list) -> np.ndarray:
    """Share of shortest paths between others that pass each node, over directed pairs."""
    held = np.zeros((n, n))
    for start, origin, to in reversed(levels):
        np.add.at(held, (start, origin), ways[start, origin] / ways[start, to] * (1 + held[start, to]))
    np.fill_diagonal(held, 0)
    total = held.sum(0)
    return total / ((n - 1) * (n - 2)) if n > 2 else total


def closeness(far: np.ndarray) -> np.ndarray:
    """Of each node: how near those are that reach it, times their share of all others."""
    n = len(far)
    reached, total = (far > 0).sum(0), np.where(far > 0, far, 0).sum(0)
    return np.divide(reached * reached, total * (n - 1), out=np.zeros(n), where=(total > 0) & (n > 1))


def pagerank(n: int, src: np.ndarray, dst: np.ndarray, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    x, out = np.full(n, 1 / n), np.bincount(src, minlength=n)
    for _ in range(most):
        before = x
        moved = np.bincount(dst, before[src] / out[src], n)
        x = damping * (moved + before[out == 0].sum() / n) + (1 - damping) / n
        if np.abs(x - before).sum() < n * tolerance:
            break
    return x


def eigenvector(n: int, src: np.ndarray, dst: np.ndarray, most: int = 1000, tolerance: float = 1e-6) -> np.ndarray:
    """Influence by repeated adding along edges; zeros if it doesn't settle."""
    x = np.full(n, 1 / n)
    for _ in range(most):
        before = x
        x = before + np.bincount(dst, before[src], n)
        x = x / (np.sqrt((x * x).sum()) or 1.0)
        if np.abs(x - before).sum() < n * tolerance:
            return x
    return np.zeros(n)


def measures(actions: np.ndarray, src: np.ndarray, dst: np.ndarray) -> dict[str, float]:
    """All ``MEASURES`` of one graph with nodes 0 to n - 1; its edges are different and no loops."""
    n = len(actions)
    far, ways, levels = searches(Adjacency(n, src, dst))
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    near, _, _ = searches(Adjacency(n, *np.divmod(both, n)))
    roots = np.where(near >= 0, np.arange(n)[None], n).min(1)
    sizes = np.bincount(roots, minlength=n)
    whole = sizes.max() == n
    first = np.bincount(dst, minlength=n) == 0
    execution = np.isin(actions, EXECUTION_ACTIONS)
    between, close = betweenness(n, ways, levels), closeness(far)
    rank, influence = pagerank(n, src, dst), eigenvector(n, src, dst)
    values = [
        (sizes > 0).sum(), sizes.max(), near.max() if whole else 0, near.max(1).min() if whole else 0, far[first].max(initial=0), (far[np.ix_(execution, execution)] > 0).sum(),
        between.max(), between.mean(), close.max(), close.mean(), rank.max(), rank.mean(), influence.max(), influence.mean(),
    ]
    return dict(zip(MEASURES, map(float, values), strict=True))


def path_measures(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, measures) of each graph of at most ``MAX_NODES`` nodes, as prune() leaves it; a larger one is an error.

    Edges whose ends are no nodes of the graph, loops and repeated edges don't count. A graph without edges has as many
    components as nodes.
    """
    kind = dict(nodes.dtypes)[by]
    ends = edges.select(F.col(by).alias("__g"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).filter("src <> dst")
    points = nodes.select(F.col(by).alias(by), F.col("node").cast("string").alias("node"), "action")

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({by: [], **{m: [] for m in MEASURES}})
        if len(left) > MAX_NODES:
            raise ValueError(f"graph {left[by].iloc[0]} has {len(left)} nodes: prune it to {MAX_NODES} first")
        left = left.drop_duplicates("node")
        place = pd.Series(np.arange(len(left)), index=left["node"])
        right = right[right["src"].isin(place.index) & right["dst"].isin(place.index)]
        n = len(left)
        keys = np.unique(place[right["src"]].to_numpy() * n + place[right["dst"]].to_numpy()) if len(right) else np.zeros(0, np.int64)
        found = measures(left["action"].to_numpy(), *np.divmod(keys, n))
        return pd.DataFrame({by: [left[by].iloc[0]], **{m: [v] for m, v in found.items()}})

    schema = f"`{by}` {kind}, " + ", ".join(f"{m} double" for m in MEASURES)
    return points.groupBy(by).cogroup(ends.groupBy("__g")).applyInPandas(one, schema)


def farthest(n: int, src: np.ndarray, dst: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each of ``starts`` the distance to the farthest of ``n`` nodes that it reaches; a few starts are searched together."""
    graph, out = Adjacency(n, src, dst), np.zeros(len(starts), np.int64)
    step = max(1, CELLS // n)
    for at in range(0, len(starts), step):
        node = starts[at : at + step]
        seen = np.zeros(len(node) * n, bool)
        own = np.arange(len(node))
        seen[own * n + node] = True
        depth = 0
        while len(node):
            out[at + own] = depth
            owner, to = graph.step(node)
            place = own[owner] * n + to
            place = np.unique(place[~seen[place]])
            seen[place] = True
            own, node = np.divmod(place, n)
            depth += 1
    return out


def component_measures(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, components, largest_component, diameter, radius) of undirected graphs of any size; the last two are 0 unless a graph hangs together.

    Components are labels that travel along edges of all graphs at once. Only graphs of one component are searched, from
    ``MAX_NODES`` of their nodes a task; a task holds the edges of the graph and a bounded number of distances.
    """
    found = stored(components(nodes, edges, by), "components")
    sizes = stored(found.groupBy(by, "component").agg(F.count("*").alias("size")), "sizes")
    counts = sizes.groupBy(by).agg(F.count("*").alias("components"), F.max("size").alias("largest_component"))
    whole = stored(counts.filter("components = 1").select(by, F.col("largest_component").alias("size")), "whole")
    parts = F.ceil(F.col("size") / MAX_NODES).cast("int")
    inner = found.join(whole, by).select(by, "node", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    ends = edges.filter("src <> dst").select(by, "src", "dst").distinct().join(whole, by)
    ends = ends.select(by, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "src", "dst")
    kind = dict(nodes.dtypes)[by]

    def search(starts: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if starts.empty:
            return pd.DataFrame({by: [], "far": [], "near": []})
        every, place = np.unique(np.concatenate([links["src"].to_numpy(), links["dst"].to_numpy(), starts["node"].to_numpy()]), return_inverse=True)
        m = len(links)
        src, dst = place[:m], place[m : 2 * m]
        far = farthest(len(every), np.concatenate([src, dst]), np.concatenate([dst, src]), place[2 * m :])
        return pd.DataFrame({by: [starts[by].iloc[0]], "far": [far.max()], "near": [far.min()]})

    searched = inner.groupBy(by, "part").cogroup(ends.groupBy(by, "part")).applyInPandas(search, f"`{by}` {kind}, far long, near long")
    ranges = searched.groupBy(by).agg(F.max("far").alias("diameter"), F.min("near").alias("radius"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return counts.join(ranges, by, "left").select(by, *map(number, ("components", "largest_component", "diameter", "radius")))
