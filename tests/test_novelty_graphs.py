"""Candidates, novelty and graph measures against plain computations on small fixtures."""

from __future__ import annotations

import itertools
import math
import random
from collections import deque

import numpy as np
import pandas as pd
import pytest

from duskwatch.functions import vectors as V
from duskwatch.operators import centrality, lsh, novelty, paths


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 64))
    made = [centres[i % 12] + 0.25 * rng.standard_normal(64) for i in range(180)]
    rows = [(i, v.tolist()) for i, v in enumerate(made)] + [(500, None), (501, [0.0] * 64), (502, made[0].tolist()), (503, (100 * rng.standard_normal(64)).tolist())]
    rows += [(600 + i, made[7].tolist()) for i in range(70)]  # more copies than a query can keep
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).cache()


def bits(v):
    return sum(1 << i for i, p in enumerate(lsh.plane_signs(40, 64)) if np.dot(p, v) > 0)


def bsf(a, b):
    a, b = np.array(a), np.array(b)
    if not a.any() or not b.any():
        return 0.0
    total = 0.0
    for name, ranges in V.BSF_SLICES_64.items():
        x, y = (np.concatenate([m[i:j] for i, j in ranges]) for m in (a, b))
        size = np.linalg.norm(x) * np.linalg.norm(y)
        total += V.BSF_WEIGHTS[name] * ((x @ y / size + 1) / 2 if size else 0)
    return total


def test_bands_find_every_pair_within_the_radius(spark, vectors):
    rows, table = vectors
    signed = {i: bits(v) for i, v in rows if v is not None}
    for most in (None, 50):
        got = sorted(tuple(r) for r in lsh.candidates(table, table.filter("vec_id % 4 = 0"), "vec_id", "embedding", 64, most=most).collect())
        want = []
        for q in signed:
            if q % 4 == 0:
                near = sorted(((signed[q] ^ signed[k]).bit_count(), k) for k in signed if k != q)
                want += [(q, k, d) for d, k in [x for x in near if x[0] <= 8][:most]]
        assert got == sorted(want) and len(want) > 300
    assert lsh.candidates(table.limit(0), table, "vec_id", "embedding", 64).count() == 0


def outlier(points):
    n = len(points)
    d = [[math.dist(a, b) for b in points] for a in points]
    far = [max(d[i][j] for j in range(n) if j != i) for i in range(n)]
    density = [1 / max(sum(max(d[i][j], far[j]) for j in range(n) if j != i) / (n - 1), 1e-12) for i in range(n)]
    return sum(density[1:]) / (n - 1) / density[0]


def test_novelty_equals_plain_computation(spark, vectors):
    rows, table = vectors
    data = {i: np.array(v) for i, v in rows if v is not None}
    signed = {i: bits(v) for i, v in data.items()}
    queries = table.filter("vec_id % 3 = 0 or vec_id > 499")
    got = {r.vec_id: r for r in novelty.score_novelty(table, queries, "vec_id", "embedding", 64, V.BSF_SLICES_64, novelty.REASONS_64).collect()}
    assert set(got) == {i for i in data if i % 3 == 0 or i > 499}
    reasons = set()
    for q, r in got.items():
        near = sorted(((signed[q] ^ signed[k]).bit_count(), k) for k in data if k != q)
        near = sorted((round(1 - bsf(data[q], data[k]), 12), k) for d, k in [x for x in near if x[0] <= 8][:50])[:5]
        reasons.add(r.reason)
        assert r.n_neighbours == len(near)
        if not near:
            assert (r.score, r.category, r.lof, r.reason) == (1.0, "high", float("inf"), "no_candidates_found")
            continue
        lof = float("inf") if len(near) < 2 else near[0][0] if len(near) < 3 else outlier([data[q], *[data[k] for _, k in near]])
        assert r.lof == pytest.approx(lof, rel=1e-6)
        d = min(1, 0.6 * near[-1][0] + 0.4 * sum(x for x, _ in near) / len(near))
        f = min((lof - 1) / 2, 1) if lof > 1 else 0
        parts = [d, f, min(1.2 * d, 1), 0.8 * d, 0.9 * f]
        assert r.score == pytest.approx(min(1, 0.6 * math.sqrt(sum(p * p for p in parts) / 5) + 0.4 * sum(w * p for w, p in zip((0.3, 0.25, 0.2, 0.15, 0.1), parts))), abs=1e-9)
        off = np.abs(data[q] - np.mean([data[k] for _, k in near], axis=0))
        assert r.parts["overall"] == pytest.approx(off.mean()) and r.parts["topology"] == pytest.approx(off[:21].mean()) and r.parts["intent"] == pytest.approx((off[:10].mean() + off[34:44].mean()) / 2)
        assert set(np.sort(off)[-5:].round(9)) == set(off[r.dimensions].round(9))
    assert reasons == {"neighbours", "no_candidates_found"}


def test_novelty_with_little_knowledge(spark, vectors):
    rows, table = vectors
    queries = table.filter("vec_id < 3")
    none = novelty.score_novelty(table.limit(0), queries, "vec_id", "embedding", 64).collect()
    assert {(r.score, r.category, r.reason) for r in none} == {(1.0, "high", "empty_knowledge_base")}
    data = dict(rows)
    few = {r.vec_id: r for r in novelty.score_novelty(table.filter("vec_id between 10 and 13"), queries, "vec_id", "embedding", 64).collect()}
    for q, r in few.items():  # the measure of 64 numbers
        assert r.score == pytest.approx(min(1, min(1 - bsf(data[q], data[k]) for k in range(10, 14)) * 1.6)) and r.reason == "small_knowledge_base" and r.n_neighbours == 4


def bfs(n, edges, start):
    far, queue = {start: 0}, deque([start])
    while queue:
        x = queue.popleft()
        for a, b in edges:
            if a == x and b not in far:
                far[b] = far[x] + 1
                queue.append(b)
    return far


def shortest(n, edges):
    """For all pairs the list of shortest paths, by walking."""
    far = [bfs(n, edges, s) for s in range(n)]
    def walk(s, t):
        if s == t:
            return [[t]]
        return [[s, *rest] for a, b in edges if a == s and far[b].get(t, -1) == far[s][t] - 1 for rest in walk(b, t)]
    return far, {(s, t): walk(s, t) for s in range(n) for t in far[s] if s != t}


@pytest.fixture(scope="module")
def random_graphs():
    rng = random.Random(6)
    out = {}
    for g in range(14):
        n = rng.randint(1, 9)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        edges = sorted(rng.sample(pairs, min(len(pairs), rng.randint(0, 2 * n))))
        out[f"g{g}"] = (n, [rng.choice(["execution", "persistence", "discovery"]) for _ in range(n)], edges)
    return out


@pytest.fixture(scope="module")
def graph_tables(spark, random_graphs):
    nodes = [(g, v, a) for g, (n, actions, _) in random_graphs.items() for v, a in enumerate(actions)]
    edges = [(g, a, b) for g, (_, _, es) in random_graphs.items() for a, b in es]
    edges += [(g, 0, 0) for g in random_graphs] + edges[:5]  # loops and repeated edges
    return spark.createDataFrame(nodes, "g string, node long, action string"), spark.createDataFrame(edges, "g string, src long, dst long")


def test_path_measures_equal_plain_search(random_graphs, graph_tables):
    got = {r.g: r for r in paths.path_measures(*graph_tables, "g").collect()}
    assert set(got) == set(random_graphs)
    for g, (n, actions, edges) in random_graphs.items():
        r, (far, ways) = got[g], shortest(n, edges)
        both = edges + [(b, a) for a, b in edges]
        near = [bfs(n, both, s) for s in range(n)]
        groups = {frozenset(x) for x in near}
        assert (r.components, r.largest_component) == (len(groups), max(map(len, groups)))
        whole = len(groups) == 1
        ecc = [max(x.values()) for x in near]
        assert (r.diameter, r.radius) == ((max(ecc), min(ecc)) if whole else (0, 0))
        starts = [v for v in range(n) if all(b != v for _, b in edges)]
        assert r.critical_path == max([max(far[v].values()) for v in starts], default=0)
        runs = [v for v in range(n) if actions[v] in paths.EXECUTION_ACTIONS]
        assert r.execution_chains == sum(t in far[s] for s in runs for t in runs if s != t)
        share = [sum(sum(v in p[1:-1] for p in ps) / len(ps) for ps in ways.values()) / ((n - 1) * (n - 2) if n > 2 else 1) for v in range(n)]
        assert r.betweenness_max == pytest.approx(max(share)) and r.betweenness_avg == pytest.approx(sum(share) / n)
        close = []
        for v in range(n):
            d = [far[s][v] for s in range(n) if s != v and v in far[s]]
            close.append(len(d) ** 2 / (sum(d) * (n - 1)) if d else 0)
        assert r.closeness_max == pytest.approx(max(close)) and r.closeness_avg == pytest.approx(sum(close) / n)


def test_messages_agree_with_arrays_and_stop(random_graphs, graph_tables):
    ranks, labels = ({} for _ in range(2))
    for r in centrality.pagerank(*graph_tables, "g", steps=12, tolerance=0.0).collect():
        ranks.setdefault(r.g, {})[r.node] = r["rank"]
    for r in centrality.components(*graph_tables, "g").collect():
        labels.setdefault(r.g, {})[r.node] = r.component
    influence = centrality.eigenvector(*graph_tables, "g", steps=8, tolerance=0.0).toPandas()
    for g, (n, _, edges) in random_graphs.items():
        src, dst = (np.array(x, dtype=np.int64) for x in (zip(*edges) if edges else ((), ())))
        plain = paths.pagerank(n, src, dst, most=12, tolerance=0.0)
        assert [ranks[g][v] for v in range(n)] == pytest.approx(plain.tolist(), abs=1e-6) and sum(ranks[g].values()) == pytest.approx(1)
        near = [bfs(n, edges + [(b, a) for a, b in edges], s) for s in range(n)]
        assert [labels[g][v] for v in range(n)] == [min(x) for x in near]
        x = np.full(n, 1 / n)
        for _ in range(8):
            x = x + np.bincount(dst, x[src], n)
            x = x / np.linalg.norm(x)
        assert influence[influence.g == g].sort_values("node").influence.tolist() == pytest.approx(x.tolist())


def test_long_chain_has_one_component(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    nodes = spark.createDataFrame([("a", v, "x") for v in range(n)], "g string, node long, action string")
    edges = spark.createDataFrame([("a", x, y) for x, y in itertools.pairwise(order)], "g string, src long, dst long")
    assert centrality.components(nodes, edges, "g").select("component").distinct().collect()[0].component == 0
    found = paths.path_measures(nodes, edges, "g").first()
    assert (found.diameter, found.radius, found.critical_path, found.components) == (n - 1, n // 2, n - 1, 1)


def test_graph_that_is_not_pruned_is_refused(spark):
    nodes = spark.range(1001).selectExpr("'a' as g", "id as node", "'x' as action")
    with pytest.raises(Exception, match="prune it"):
        paths.path_measures(nodes, spark.createDataFrame([], "g string, src long, dst long"), "g").collect()
