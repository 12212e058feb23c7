"""Learning from feedback: calibration, classifiers, evaluation and triggers, on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.stats import f1, ratio

from .numbering import numbered

MIN_CALIBRATION = 5
# Feedback factors and the range of a weight.
FACTORS = {"true_positive": 1.02, "false_positive": 0.98, "false_negative": 1.05}
WEIGHT_RANGE = (0.5, 2.0)


def fit_platt(scores: DataFrame, score: str, truth: str) -> tuple[float, float] | None:
    """(a, b) of 1 / (1 + exp(a * score + b)), None with fewer than five scores or a single class."""
    n = scores.agg(F.count("*").alias("n"), F.countDistinct(truth).alias("k")).first()
    if n["n"] < MIN_CALIBRATION or n["k"] < 2:
        return None
    rows = VectorAssembler(inputCols=[score], outputCol="features").transform(scores.select(F.col(score).cast("double"), F.col(truth).cast("double").alias("label")))
    model = LogisticRegression(regParam=1.0 / n["n"], standardization=False).fit(rows)
    return -float(model.coefficients[0]), -float(model.intercept)


def classifier(trees: int = 50, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[RandomForestClassifier(numTrees=trees, seed=seed, featuresCol="features", labelCol="label")])


def with_vector(df: DataFrame, vector: str, label: str) -> DataFrame:
    return df.select("*", array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("__label")).withColumn("label", F.col("__label")).drop("__label")


def predict(model, df: DataFrame, key: str, truth: str) -> DataFrame:
    out = model.transform(df)
    return out.select(key, F.col(truth).cast("int").alias("truth"), F.col("prediction").cast("int").alias("predicted"), F.array_max(vector_to_array("probability")).alias("top"))


def evaluation(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall, F1 and accuracy over all, from one count per pair of classes."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    actual = pairs.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    claimed = pairs.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("claimed"))
    both = actual.join(claimed, "class", "full_outer").na.fill(0)
    both = both.withColumn("precision", ratio(F.col("tp"), F.col("claimed"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    total = Window.partitionBy()
    return both.select("class", "support", "precision", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"), (F.sum("tp").over(total) / F.sum("support").over(total)).alias("accuracy"))


def adjusted_weights(feedback: DataFrame, key: str, kind: str, order: list[str], chunk: int = 1000) -> DataFrame:
    """Weight of each key after its feedback in order: every step multiplies and clamps, so the order counts.

    Steps in a row are one map x -> clamp(x * factor, low, high) again, so ``chunk`` neighbouring ones are folded into one at a
    time until each key has one; no task gathers more of a key. Keys may be null. Steps that tie on ``order`` come in any order.
    """
    table = F.create_map(*[F.lit(x) for kv in FACTORS.items() for x in kv])
    low, high = WEIGHT_RANGE
    step = F.struct(F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(1.0)).alias("factor"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    rows = numbered(feedback.select(key, *order, step.alias("step")), order, [key]).select(key, "number", "step")
    clamp = lambda x, s: F.greatest(s["low"], F.least(s["high"], x * s["factor"]))
    after = lambda a, s: F.struct((a["factor"] * s["factor"]).alias("factor"), clamp(a["low"], s).alias("low"), clamp(a["high"], s).alias("high"))
    start = F.struct(F.lit(1.0).alias("factor"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    most = rows.agg(F.max("number")).first()[0] or 0
    while most > 1:
        steps = F.array_sort(F.collect_list(F.struct("number", "step")))
        folded = F.aggregate(steps, start, lambda a, r: after(a, r["step"]))
        rows = rows.groupBy(key, F.floor((F.col("number") - 1) / chunk).alias("at")).agg(folded.alias("step")).select(key, (F.col("at") + 1).alias("number"), "step")
        most = -(-most // chunk)
    return rows.select(key, clamp(F.lit(1.0), F.col("step")).alias("weight"))


def retraining_triggers(n_new: Column, accuracy: Column, baseline: Column, growth: int = 100, drop: float = 0.05) -> Column:
    """Names of the triggers that fire."""
    return F.array_compact(F.array(F.when(n_new >= growth, F.lit("growth")), F.when(baseline - accuracy > drop, F.lit("accuracy_drop"))))


def kmeans(df: DataFrame, k: int, seed: int = 42, iterations: int = 20):
    return KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="features").fit(df)


def averages(per_class: DataFrame) -> DataFrame:
    """One row from evaluation(): accuracy, and precision, recall and F1 averaged over classes (macro) and by support (weighted)."""
    total = F.sum("support")
    mean = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.when(total > 0, F.sum(F.col(c) * F.col("support")) / total).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return per_class.agg(F.max("accuracy").alias("accuracy"), *mean, *weighted)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows for every pair of true and predicted class that occurs."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def fold(key: str, folds: int = 5) -> Column:
    """A fold from 0 that depends on the key alone, so reruns and any partitioning agree."""
    return F.pmod(F.xxhash64(F.lit("fold"), F.col(key).cast("string")), F.lit(folds)).cast("int")


def ensemble(n_features: int, n_classes: int, trees: int = 50, seed: int = 42) -> list:
    """Random forest, one-against-rest support vectors and a multilayer perceptron, to be fitted on the same rows."""
    forest = RandomForestClassifier(numTrees=trees, seed=seed)
    vectors = OneVsRest(classifier=LinearSVC(maxIter=30, regParam=0.01), parallelism=2)
    layers = MultilayerPerceptronClassifier(layers=[n_features, 32, n_classes], seed=seed, maxIter=60)
    return [forest, vectors, layers]


def fit_ensemble(rows: DataFrame, n_features: int, n_classes: int, trees: int = 50, seed: int = 42) -> list:
    """The fitted models of ensemble() on rows with ``features`` and ``label`` (0 to n_classes - 1)."""
    return [m.fit(rows) for m in ensemble(n_features, n_classes, trees, seed)]


def classify(models: list, rows: DataFrame, key: str, n_classes: int) -> DataFrame:
    """(key, predicted, probability, votes): the mean of the models' class probabilities, its top class (the lowest of equals), and who votes for it.

    Support vectors give no probabilities; their margins go through a softmax.
    """
    out = rows
    for i, model in enumerate(models):
        scores = vector_to_array("probability") if "probability" in model.transform(rows).columns else vector_to_array("rawPrediction")
        scored = model.transform(out).withColumn(f"__s{i}", scores)
        if "probability" not in scored.columns:
            top = F.array_max(f"__s{i}")
            scored = scored.withColumn(f"__s{i}", F.transform(f"__s{i}", lambda x: F.exp(x - top)))
            whole = F.aggregate(f"__s{i}", F.lit(0.0), lambda a, x: a + x)
            scored = scored.withColumn(f"__s{i}", F.transform(f"__s{i}", lambda x: x / whole))
        out = scored.drop("probability", "rawPrediction", "prediction")
    each = [F.col(f"__s{i}") for i in range(len(models))]
    mean = F.array(*[sum((F.get(s, F.lit(c)) for s in each), F.lit(0.0)) / len(models) for c in range(n_classes)])
    out = out.withColumn("probabilities", mean).withColumn("probability", F.array_max("probabilities")).withColumn("predicted", F.array_position("probabilities", F.col("probability")).cast("int") - 1)
    votes = sum(((F.array_position(s, F.array_max(s)) - 1 == F.col("predicted")).cast("int") for s in each), F.lit(0))
    return out.select(key, "predicted", "probability", votes.alias("votes"))


def cross_validated(rows: DataFrame, key: str, n_features: int, n_classes: int, folds: int = 5, trees: int = 50, seed: int = 42) -> DataFrame:
    """(fold, key, truth, predicted, probability, votes): every row judged by an ensemble fitted on the other folds."""
    placed = rows.withColumn("fold", fold(key, folds))
    out = None
    for i in range(folds):
        test = placed.filter(F.col("fold") == i)
        models = fit_ensemble(placed.filter(F.col("fold") != i), n_features, n_classes, trees, seed)
        found = classify(models, test, key, n_classes).join(test.select(key, "fold", F.col("label").cast("int").alias("truth")), key)
        out = found if out is None else out.unionByName(found)
    return out.select("fold", key, "truth", "predicted", "probability", "votes")
