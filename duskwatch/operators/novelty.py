"""How new a behaviour vector is against known ones: candidates, exact neighbours, outlier factor, score, category, reasons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import scoring as S
from duskwatch.functions import vectors as V

from . import similarity
from .lsh import candidates, exact_nearest

NEIGHBOURS, FEW_KNOWN, NOVEL = 5, 10, 0.8
# The parts of a vector of 128 that the reasons are means of; a part of several ranges is the mean of their means.
REASONS = {
    "vocabulary": ((68, 128),), "topology": ((0, 43),), "timing": ((43, 68),), "intent": ((0, 20), (68, 88)), "edge": ((20, 43), (43, 68), (108, 128)),
}
#: The same parts for vectors of 64 numbers.
REASONS_64 = {name: tuple((a // 2, b // 2) for a, b in ranges) for name, ranges in REASONS.items()}


def _facts(reasons: dict, top: int):
    """Outlier factor and deviations of each query from its neighbours."""
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lofs, parts, dims = [], [], []
            for own, others, nearest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                points = np.nan_to_num(np.array([own, *others], float))
                n = len(others)
                lofs.append(float("inf") if n < 2 else nearest if n < 3 else float(similarity.local_outlier_factor(points, NEIGHBOURS)[0]))
                off = np.abs(points[0] - points[1:].mean(0))
                means = [float(np.mean([off[a:b].mean() for a, b in ranges])) for ranges in reasons.values()]
                parts.append([*means, float(off.mean()), float(np.sqrt(np.mean(np.square(means))))])
                dims.append(sorted(np.lexsort((np.arange(len(off)), off))[-top:].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lofs, pa.float64()), pa.array(parts, pa.list_(pa.float64())), pa.array(dims, pa.list_(pa.int32()))], names=["query", "lof", "parts", "dimensions"])

    return facts


def neighbours(known: DataFrame, queries: DataFrame, key: str, vector: str, size: int, slices: dict | None = None) -> DataFrame:
    """The nearest of each query's candidates by exact behavioural distance."""
    return exact_nearest(candidates(known, queries, key, vector, size), known, queries, key, vector, NEIGHBOURS, slices)


def score_novelty(known: DataFrame, queries: DataFrame, key: str, vector: str, size: int, slices: dict | None = None, reasons: dict | None = None, measure: str = "behavioural") -> DataFrame:
    """One row per query: key, score, category, lof, n_neighbours, reason, parts (a map of mean deviations) and the most deviating dimensions.

    Without known vectors, or without a candidate, a query is as new as can be. Up to ``FEW_KNOWN`` known vectors the
    distance to the nearest counts, raised the more the fewer there are. Else the score combines the distance to the
    nearest ``NEIGHBOURS`` with a local outlier factor. A query's own row is none of its neighbours; vectors that are
    null are left out.
    """
    slices, reasons = slices or V.BSF_SLICES, reasons or REASONS
    queries, known = queries.filter(F.col(vector).isNotNull()), known.filter(F.col(vector).isNotNull())
    n = len(known.select(key).take(FEW_KNOWN))
    names = [*reasons, "overall", "p_norm"]
    kind = dict(queries.dtypes)[key]
    all_new = lambda reason: [F.lit(1.0).alias("score"), F.lit(float("inf")).alias("lof"), F.lit(0).cast("long").alias("n_neighbours"), F.lit(reason).alias("reason"), _map(names, lambda i: F.lit(1.0)), F.array().cast("array<int>").alias("dimensions")]
    if n == 0:
        return _categorised(queries.select(key, *all_new("empty_knowledge_base")), key)
    if n < FEW_KNOWN:
        near = similarity.nearest(known, queries, key, vector, NEIGHBOURS, measure).groupBy(F.col("query").alias(key)).agg(F.min("distance").alias("d"), F.count("*").alias("n_neighbours"))
        score = F.least(F.lit(1.0), F.col("d") * (2 - n / FEW_KNOWN))
        few = near.select(key, score.alias("score"), F.lit(1.0).alias("lof"), "n_neighbours", F.lit("small_knowledge_base").alias("reason"), F.map_from_arrays(F.array(), F.array()).cast("map<string,double>").alias("parts"), F.array().cast("array<int>").alias("dimensions"))
        alone = queries.join(near, key, "left_anti").select(key, *all_new("no_candidates_found"))
        return _categorised(few.unionByName(alone), key)
    near = neighbours(known, queries, key, vector, size, slices)
    held = near.groupBy("query").agg(
        F.first("own").alias("own"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"]).alias("others"),
        F.min("distance").alias("nearest"), F.max("distance").alias("last"), F.avg("distance").alias("mean"), F.count("*").alias("n"),
    )
    # at most NEIGHBOURS vectors to a row
    facts = held.select("query", "own", "others", "nearest").mapInArrow(_facts(reasons, 5), f"query {kind}, lof double, parts array<double>, dimensions array<int>")
    scored = held.select("query", "last", "mean", "n").join(facts, "query")
    score = S.novelty(S.distance_novelty(F.col("last"), F.col("mean")), F.col("lof"))
    scored = scored.select(F.col("query").alias(key), score.alias("score"), "lof", F.col("n").alias("n_neighbours"), F.lit("neighbours").alias("reason"), _map(names, lambda i: F.get("parts", F.lit(i))), "dimensions")
    alone = queries.join(scored.select(key), key, "left_anti").select(key, *all_new("no_candidates_found"))
    return _categorised(scored.unionByName(alone), key)


def _map(names: list[str], value) -> Column:
    return F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), value(i))]).alias("parts")


def _categorised(scored: DataFrame, key: str) -> DataFrame:
    return scored.select(key, "score", S.novelty_category(F.col("score")).alias("category"), "lof", "n_neighbours", "reason", "parts", "dimensions")


def novel_items(scored: DataFrame, threshold: float = NOVEL) -> DataFrame:
    """Rows whose score reaches the threshold, newest first."""
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"))
