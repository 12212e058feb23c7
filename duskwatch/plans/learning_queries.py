"""Queries that learn: classifiers, calibration, feedback weights, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import learning

from .registry import register


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.with_vector(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", "label")


@register("classifier_evaluation")
def classifier_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random forest on four fifths of the vectors by id, judged on the rest."""
    rows = _vectors(spark, sf_dir)
    model = learning.classifier().fit(rows.filter("vec_id % 5 <> 0"))
    return learning.evaluation(learning.predict(model, rows.filter("vec_id % 5 = 0"), "vec_id", "label"), "truth", "predicted")


@register("kmeans_sizes")
def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return learning.kmeans(rows, 10).transform(rows).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@register("platt_calibration")
def platt_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    rows = labels.select((F.col("n_chars") / 10000).alias("score"), "toxic")
    fitted = learning.fit_platt(rows, "score", "toxic")
    a, b = fitted or (None, None)
    return spark.createDataFrame([(a, b)], "a double, b double")


@register(
    "feedback_weights",
    """
    WITH RECURSIVE f AS (SELECT user_id, CASE event_type WHEN 'view' THEN 1.02e0 WHEN 'click' THEN 0.98e0 WHEN 'error' THEN 1.05e0 ELSE 1e0 END AS factor,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT user_id, rn, n, greatest(0.5e0, least(2e0, factor)) AS weight FROM f WHERE rn = 1
      UNION ALL SELECT f.user_id, f.rn, f.n, greatest(0.5e0, least(2e0, w.weight * f.factor)) FROM w JOIN f ON f.user_id = w.user_id AND f.rn = w.rn + 1)
    SELECT user_id, round(weight, 6) AS weight FROM w WHERE rn = n
    """,
)
def feedback_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.expr("CASE event_type WHEN 'view' THEN 'true_positive' WHEN 'click' THEN 'false_positive' WHEN 'error' THEN 'false_negative' END")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kind", kinds)
    return learning.adjusted_weights(rows, "user_id", "kind", ["ts", "event_id"]).select("user_id", F.round("weight", 6).alias("weight"))


@register(
    "retraining_triggers",
    """
    SELECT d.lang, count(*) AS n, concat_ws(',', CASE WHEN count(*) >= 100 THEN 'growth' END, CASE WHEN 0.9e0 - avg(CASE WHEN l.toxic = 0 THEN 1e0 ELSE 0e0 END) > 0.05e0 THEN 'accuracy_drop' END) AS triggers
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang
    """,
)
def retraining_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    g = rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg((F.col("toxic") == 0).cast("double")).alias("accuracy"))
    return g.select("lang", "n", F.array_join(learning.retraining_triggers(F.col("n"), F.col("accuracy"), F.lit(0.9)), ",").alias("triggers"))


_JUDGED = """
    j AS (SELECT event_id, event_type AS truth, CASE event_id % 7 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE event_type END AS predicted FROM events),
    c AS (SELECT truth AS class, count(*) AS support, count(*) FILTER (truth = predicted) AS tp FROM j GROUP BY 1), p AS (SELECT predicted AS class, count(*) AS claimed FROM j GROUP BY 1),
    m AS (SELECT class, support, tp, coalesce(tp / claimed, 0) AS precision, tp / support AS recall FROM c LEFT JOIN p USING (class)),
    f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM m)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    claimed = F.when(F.col("event_id") % 7 == 0, "view").when(F.col("event_id") % 7 == 1, "click").otherwise(F.col("event_type"))
    return e.select("event_id", F.col("event_type").alias("truth"), claimed.alias("predicted"))


@register(
    "evaluation_averages",
    f"""
    WITH {_JUDGED} SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
      round(sum(precision * support) / sum(support), 9) AS weighted_precision, round(sum(recall * support) / sum(support), 9) AS weighted_recall, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM f
    """,
)
def evaluation_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of a judgement of all events."""
    found = learning.averages(learning.evaluation(_judged(spark, sf_dir), "truth", "predicted"))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@register("confusion_table", f"WITH {_JUDGED} SELECT truth, predicted, count(*) AS n FROM j GROUP BY ALL")
def confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.confusion(_judged(spark, sf_dir), "truth", "predicted")
