"""The ensemble on vectors whose classes lie apart, judged out of fold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import learning


def test_every_row_is_judged_by_models_that_did_not_see_it(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (4 * np.eye(4)[i % 3] + rng.normal(size=4) * 0.4).tolist(), i % 3) for i in range(120)]
    table = learning.with_vector(spark.createDataFrame(rows, "id long, v array<double>, kind int"), "v", "kind").cache()
    found = learning.cross_validated(table, "id", 4, 3, folds=2, trees=10).toPandas()
    assert sorted(found.id) == list(range(120)) and set(found.fold) == {0, 1}
    assert (found.truth == found.predicted).mean() > 0.95 and (found.truth == found.id % 3).all()
    assert found.probability.between(1 / 3, 1).all() and found.votes.between(0, 3).all() and (found.votes == 3).mean() > 0.8


def test_averages_of_classes(spark):
    judged = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "truth string, predicted string")
    r = learning.averages(learning.evaluation(judged, "truth", "predicted")).first()
    assert (r.accuracy, r.macro_precision, r.macro_recall) == (0.5, pytest.approx(1 / 3), pytest.approx(0.5))
    assert r.weighted_recall == pytest.approx(0.5) and r.weighted_precision == pytest.approx((2 * 0.5 + 0.5) / 4)
    assert sorted(map(tuple, learning.confusion(judged, "truth", "predicted").collect())) == [("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("c", "a", 1)]


def test_folds_depend_on_keys_alone(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    a = dict(map(tuple, rows.select("k", learning.fold("k").alias("f")).collect()))
    b = dict(map(tuple, rows.repartition(7).orderBy(F.desc("k")).select("k", learning.fold("k").alias("f")).collect()))
    assert a == b and set(a.values()) == {0, 1, 2, 3, 4} and min(list(a.values()).count(f) for f in range(5)) > 150
