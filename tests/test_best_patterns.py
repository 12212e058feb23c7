"""The best pattern of each row against the expression of the similarity, pair by pair."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.functions import vectors as V
from duskwatch.operators import similarity


@pytest.mark.parametrize("most", [5, 5000])
def test_best_patterns_equal_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(similarity, "MAX_QUERIES", most)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 128))
    vectors[3] = 0
    rows = spark.createDataFrame([(f"g{i}", v.tolist()) for i, v in enumerate(vectors[:40])] + [("none", None)], "graph string, embedding array<double>").repartition(3)
    patterns = spark.createDataFrame([(f"p{i % 18}", f"t{i}", v.tolist()) for i, v in enumerate(vectors[40:])] + [("p0", "zz", vectors[40].tolist()), ("x", "t", None)], "name string, threat string, embedding array<double>")
    pairs = rows.crossJoin(patterns.select("name", "threat", F.col("embedding").alias("p"))).filter("embedding is not null and p is not null").withColumn("s", V.bsf(F.col("embedding"), F.col("p")))
    want = pairs.groupBy("graph").agg(F.max(F.struct(F.round("s", 12), "name", "threat")).alias("b"), F.count_if(F.col("s") > 0.5).alias("m"), F.count("*").alias("n")).collect()
    got = {r.graph: r for r in similarity.best_patterns(rows, patterns, "graph", "embedding", 0.5).collect()}
    assert len(got) == len(want) == 40
    for r in want:
        g = got[r.graph]
        assert (g.name, g.threat, g.matches, g.patterns) == (r.b["name"], r.b["threat"], r.m, r.n) and g.similarity == pytest.approx(r.b[0], abs=1e-9)
    assert similarity.best_patterns(rows, patterns.limit(0), "graph", "embedding", 0.5).count() == 0
    assert similarity.best_patterns(rows.limit(0), patterns, "graph", "embedding", 0.5).count() == 0
