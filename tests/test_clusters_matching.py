"""Clusters, seeds and words in texts against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import clusters, intel, matching, similarity


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(6)[i % 5] + rng.normal(size=6) * 0.22).tolist()) for i in range(150)]
    rows += [(900, [0.0] * 6), (901, None), (902, rows[3][1]), (903, rows[3][1]), (904, [-1.0] * 6), (905, [-2.0] * 6), (906, [-1.0] * 6)]
    return rows, spark.createDataFrame([(*r, "x" if r[0] % 3 else "y", ["t1", "t2"] if r[0] % 2 else ["t1"]) for r in rows], "id long, v array<double>, kind string, techniques array<string>").repartition(3)


def plain_dbscan(rows, eps, least):
    real = {i: np.array(v) for i, v in rows if v is not None and any(v)}
    near = {i: [k for k, w in real.items() if k != i and 1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w) <= eps + 1e-12] for i, v in real.items()}
    core = {i for i in real if len(near[i]) + 1 >= least}
    name = {}
    for i in sorted(core):
        if i not in name:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in name:
                    name[x] = i
                    todo += [k for k in near[x] if k in core]
    return {i: name.get(i) if i in core else min([name[k] for k in near.get(i, []) if k in core], default=None) for i, _ in rows}


def test_density_clusters_equal_plain_search(vectors):
    rows, table = vectors
    for eps, least, seeds in ((0.02, 3, 32), (0.05, 3, 4), (0.08, 6, 1), (0.15, 3, 32)):
        got = {r.id: r.cluster for r in clusters.dbscan(table, "id", "v", eps, least, seeds).collect()}
        assert got == plain_dbscan(rows, eps, least), (eps, least)
    assert clusters.dbscan(table.limit(0), "id", "v", 0.1, 3).count() == 0


def test_campaign_rows(vectors):
    rows, table = vectors
    name = plain_dbscan(rows, 0.05, 3)
    data = table.withColumn("at", F.col("id"))
    got = {r.cluster: r for r in clusters.campaigns(clusters.dbscan(table, "id", "v", 0.05, 3), data, "id", "v", "kind", "at", "techniques", share=0.5).collect()}
    assert set(got) == set(name.values()) - {None}
    for c, r in got.items():
        members = [i for i, n in name.items() if n == c]
        assert (r.members, r.first_seen, r.last_seen) == (len(members), min(members), max(members))
        assert r.centroid == pytest.approx(np.mean([v for i, v in rows if i in members], axis=0).tolist())
        kinds = ["x" if i % 3 else "y" for i in members]
        assert r.kind == min(set(kinds), key=lambda k: (-kinds.count(k), k))
        assert r.techniques == ["t1"] + (["t2"] if sum(i % 2 for i in members) >= 0.5 * len(members) else [])


def test_seeds_are_far_apart_and_kmeans_follows(vectors):
    rows, table = vectors
    data = {i: np.array(v) for i, v in rows if v is not None}
    seeds = clusters.farthest_first(table, "id", "v", 6)
    want = [min(data)]
    while len(want) < 6:
        want.append(min(data, key=lambda i: (-min(round(float(np.linalg.norm(data[i] - data[s])), 9) for s in want), i)))
    assert [k for k, _ in seeds] == want
    centres = [data[i] for i in want]
    for _ in range(3):
        nearest = {i: int(np.argmin([round(float(np.linalg.norm(v - c)), 9) for c in centres])) for i, v in data.items()}
        centres = [np.mean([data[i] for i in data if nearest[i] == k], axis=0) if k in nearest.values() else c for k, c in enumerate(centres)]
    assert np.allclose(clusters.kmeans_from(table, "id", "v", [v for _, v in seeds], 3), centres)
    few = table.filter("id in (3, 902, 903)")
    assert [k for k, _ in clusters.farthest_first(few, "id", "v", 6)] == [3] and clusters.farthest_first(table.limit(0), "id", "v", 3) == []


def test_words_in_texts_by_automaton_and_by_grams(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcß ") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(100, None), (101, ""), (102, "abcabcabc")]
    words = ["".join(rng.choice("abcß") for _ in range(rng.randint(1, 6))) for _ in range(90)] + ["", None, "zzzzz", "abcabc", "abcabc"]
    table, listed = spark.createDataFrame(texts, "id long, text string").repartition(3), spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((i, w) for i, t in texts if t for w in {w for w in words if w} if w in t)
    for most in (matching.AUTOMATON_CHARS, 40, 1):
        assert sorted(tuple(r) for r in matching.substring_matches(table, "id", "text", listed, "w", most).collect()) == want
    assert matching.substring_matches(table, "id", "text", listed.limit(0), "w").count() == 0


def test_either_side_may_hold_the_other(spark):
    left, right = spark.createDataFrame([("evil.example",), ("10.0.0.1",), ("a",), ("a",)], "i string"), spark.createDataFrame([("http://evil.example/x",), ("0.0",), ("zzz",), (None,)], "o string")
    assert sorted(map(tuple, matching.either_contains(left, right, "i", "o").collect())) == [("10.0.0.1", "0.0"), ("a", "http://evil.example/x"), ("evil.example", "http://evil.example/x")]
    rows = spark.createDataFrame([(1, "An IDIOT here"), (2, None)], "id long, t string")
    assert [tuple(r) for r in intel.containing(rows, "id", "t", spark.createDataFrame([("Idiot",), ("",)], "word string"), "word").collect()] == [(1, "Idiot")]


def test_best_signature_with_text_names_and_ties(spark):
    rows = spark.createDataFrame([(1, [1.0] * 64), (2, [-1.0] * 64), (3, None)], "id long, v array<double>")
    known = spark.createDataFrame([("b", [2.0] * 64), ("a", [1.0] * 64), ("z", [0.0] * 64)], "name string, v array<double>")
    assert [tuple(r) for r in similarity.best_signature(rows, known, "id", "v", "name", 0.7).select("id", "name").collect()] == [(1, "a")]
