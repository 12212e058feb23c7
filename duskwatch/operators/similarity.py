"""Similarity search over vectors.

Queries go to every task in blocks of at most ``MAX_QUERIES``, one pass over the rows for each block; rows stay
distributed. A task compares an Arrow batch of rows with a block by matrix products and hands on what is asked for only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import vectors as V

#: At most so many query vectors go to every task at once.
MAX_QUERIES = 5_000
#: Numbers of a matrix of distances that a task holds at once.
_CELLS = 1 << 20
#: Pairs that a task hands on at once, about.
_PAIRS = 1 << 17


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(_unit(a) @ _unit(b).T, -1, 1)


def _both_nonzero(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.any(a, axis=1)[:, None] & np.any(b, axis=1)[None]


def _behavioural(a: np.ndarray, b: np.ndarray, slices: dict = V.BSF_SLICES_64) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for name, ranges in slices.items():
        x, y = (np.concatenate([m[:, i:j] for i, j in ranges], axis=1) for m in (a, b))
        total += V.BSF_WEIGHTS[name] * np.where(_both_nonzero(x, y), (_cosine(x, y) + 1) / 2, 0.0)
    return np.where(_both_nonzero(a, b), np.clip(total, 0, 1), 0.0)


def _by_query(one: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def every(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(b)))
        for j, x in enumerate(b):
            out[:, j] = one(a - x)
        return out

    return every


MEASURES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": lambda a, b: 1 - _cosine(a, b),
    "euclidean": _by_query(lambda d: np.sqrt((d * d).sum(axis=1))),
    "manhattan": _by_query(lambda d: np.abs(d).sum(axis=1)),
    "behavioural": lambda a, b: 1 - _behavioural(a, b),
}


def _blocks(queries: DataFrame, key: str) -> Iterator[DataFrame]:
    """The queries in blocks of about half of ``MAX_QUERIES``, split by a hash of the key; one block if they are few."""
    n = queries.count()
    if n <= MAX_QUERIES:
        yield queries
        return
    n = 2 * -(-n // MAX_QUERIES)
    for i in range(n):
        yield queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def _small(queries: DataFrame) -> DataFrame:
    """Broadcast if the queries are few, else left to Spark."""
    return F.broadcast(queries) if queries.limit(MAX_QUERIES + 1).count() <= MAX_QUERIES else queries


def _kept_pairs(kept: np.ndarray, most: int = _PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of what is kept, by rows of about ``most`` cells, so that no task holds all places at once."""
    few = max(1, most // max(1, kept.shape[1]))
    for top in range(0, len(kept), few):
        i, j = np.nonzero(kept[top : top + few])
        yield i + top, j


def _compared(rows: DataFrame, queries: DataFrame, key: str, vector: str, measure: str, keep: Callable[[np.ndarray], np.ndarray] | None, each_task: Callable | None = None) -> DataFrame:
    """(query, key, distance) where ``keep(distances)`` says so, pairs with itself left out; null vectors have no pairs.

    ``each_task()`` gives every task a ``keep`` of its own, which may remember what it saw.
    """
    kind = rows.schema[key].dataType.simpleString()
    base = rows.filter(F.col(vector).isNotNull()).select(F.col(key), V.doubles(F.col(vector)).alias("v"))
    out = None
    for block in _blocks(queries.filter(F.col(vector).isNotNull()), key):
        table = block.select(F.col(key), V.doubles(F.col(vector)).alias("v")).toArrow()
        asked = table.column(0).to_numpy()
        matrix = np.array(table.column(1).to_pylist(), float).reshape(len(asked), -1)
        shared = rows.sparkSession.sparkContext.broadcast((asked, matrix))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, matrix = shared.value
            chosen = each_task() if each_task else keep
            step = max(1, _CELLS // max(1, len(asked)))
            for batch in batches:
                for at in range(0, len(batch) if len(asked) else 0, step):
                    part = batch.slice(at, step)
                    keys = part.column(0).to_numpy()
                    own = part.column(1).flatten().to_numpy().reshape(len(part), -1)
                    far = MEASURES[measure](own, matrix)
                    far[keys[:, None] == asked[None]] = np.nan
                    for i, j in _kept_pairs(chosen(far) & ~np.isnan(far)):
                        yield pa.RecordBatch.from_arrays([pa.array(asked[j]), pa.array(keys[i]), pa.array(far[i, j])], names=["query", key, "distance"])

        found = base.mapInArrow(compare, f"query {kind}, `{key}` {kind}, distance double")
        out = found if out is None else out.unionByName(found)
    return out


def distances(rows: DataFrame, queries: DataFrame, key: str, vector: str, measure: str = "cosine") -> DataFrame:
    """(query, key, distance) of every row to every query, pairs with itself left out. Keys are integers."""
    return _compared(rows, queries, key, vector, measure, lambda far: np.ones(far.shape, bool))


def near_enough(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, measure: str = "cosine", slack: float = 0.0) -> DataFrame:
    """(query, key, distance) of the k nearest rows of each query, all others within ``slack`` of the last, and a few more.

    A task remembers for each query the least k-th distance of a batch, and hands on no row beyond it: so what is
    shuffled grows with tasks and queries, not with rows times queries.
    """

    def each_task() -> Callable[[np.ndarray], np.ndarray]:
        bound = np.inf

        def keep(far: np.ndarray) -> np.ndarray:
            nonlocal bound
            filled = np.where(np.isnan(far), np.inf, far)
            if len(filled) >= k:
                bound = np.minimum(bound, np.partition(filled, k - 1, axis=0)[k - 1])
            return filled <= bound + slack

        return keep

    return _compared(rows, queries, key, vector, measure, None, each_task)


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, measure: str = "cosine") -> DataFrame:
    """The k nearest rows of each query, ties by key; each task leaves out before the shuffle what can't be among them."""
    w = Window.partitionBy("query").orderBy("distance", key)
    return near_enough(rows, queries, key, vector, k, measure).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def at_least(rows: DataFrame, queries: DataFrame, key: str, vector: str, similarity: float) -> DataFrame:
    """Pairs with a raw cosine of at least ``similarity``."""
    close = _compared(rows, queries, key, vector, "cosine", lambda far: far <= 1 - similarity + 1e-12)
    return close.select("query", key, (1 - F.col("distance")).alias("similarity")).filter(F.col("similarity") >= similarity)


def best_signature(rows: DataFrame, signatures: DataFrame, key: str, vector: str, name: str, above: float) -> DataFrame:
    """(key, name, similarity): best signature of each row if its behavioural similarity is above the limit; ties by name.

    Signatures are the queries: they go to every task in blocks, whatever the type of their name.
    """
    named = signatures.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.lit("signature"), F.col(name).cast("string")).alias(key), F.col(name), F.col(vector))
    pairs = _compared(rows, named, key, vector, "behavioural", lambda far: far < 1 - above)
    scored = pairs.withColumn("similarity", 1 - F.col("distance")).join(_small(named.select(F.col(key).alias("query"), name)), "query")
    w = Window.partitionBy(key).orderBy(F.round("distance", 12), name)
    return scored.withColumn("__rn", F.row_number().over(w)).filter((F.col("__rn") == 1) & (F.col("similarity") > above)).select(key, name, "similarity")


def best_patterns(rows: DataFrame, patterns: DataFrame, key: str, vector: str, above: float, slices: dict = V.BSF_SLICES) -> DataFrame:
    """(key, similarity, name, threat, matches, patterns): each row's most similar pattern, how many are above the limit, and of how many.

    Patterns (name, threat, ``vector``) go to every task in blocks, and a task hands on one row for each row and block. Ties on 12
    decimals go to the largest name, then threat. Rows with a null vector have none, and without patterns no row has one.
    """
    known = patterns.filter(F.col(vector).isNotNull()).select("name", "threat", V.doubles(F.col(vector)).alias("v"))
    base = rows.filter(F.col(vector).isNotNull()).select(F.col(key), V.doubles(F.col(vector)).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in (*rows.select(key).schema, *known.select("name", "threat").schema)}
    out_type = f"`{key}` {kinds[key]}, similarity double, name {kinds['name']}, threat {kinds['threat']}, matches long, patterns long"
    found = rows.sparkSession.createDataFrame([], out_type)
    for block in _blocks(known, "name"):
        table = block.toArrow().sort_by([("name", "ascending"), ("threat", "ascending")])
        if not len(table):
            continue
        matrix = np.array(table.column("v").to_pylist(), float).reshape(len(table), -1)
        shared = rows.sparkSession.sparkContext.broadcast((table.select(["name", "threat"]).combine_chunks(), matrix))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            step = max(1, _CELLS // len(matrix))
            for batch in batches:
                for at in range(0, len(batch), step):
                    part = batch.slice(at, step)
                    near = _behavioural(part.column(1).flatten().to_numpy().reshape(len(part), -1), matrix, slices)
                    best = len(matrix) - 1 - np.round(near, 12)[:, ::-1].argmax(axis=1)
                    picked = names.take(pa.array(best))
                    columns = [part.column(0), pa.array(near[np.arange(len(part)), best]), *[picked.column(c).combine_chunks() for c in ("name", "threat")],
                               pa.array((near > above).sum(axis=1)), pa.array(np.full(len(part), len(matrix)))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "similarity", "name", "threat", "matches", "patterns"])

        found = found.unionByName(base.mapInArrow(compare, out_type))
    best = F.max(F.struct(F.round("similarity", 12), "name", "threat", "similarity")).alias("b")
    return found.groupBy(key).agg(best, F.sum("matches").alias("matches"), F.sum("patterns").alias("patterns")).select(key, "b.similarity", "b.name", "b.threat", "matches", "patterns")


def centroid(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """Mean vector of each group: element-wise averages, put back in order."""
    parts = rows.select(by, F.posexplode(V.doubles(F.col(vector))).alias("at", "x")).groupBy(by, "at").agg(F.avg("x").alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "mean")))
    return parts.groupBy(by).agg(F.transform(ordered, lambda s: s["mean"]).alias("centroid"))


def local_outlier_factor(points: np.ndarray, k: int) -> np.ndarray:
    """Local outlier factor of each of a few points by Euclidean distance."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    k = min(k, len(points) - 1)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    reach_of = np.take_along_axis(d, order, 1)[:, -1]
    reach = np.maximum(np.take_along_axis(d, order, 1), reach_of[order])
    density = 1 / np.maximum(reach.mean(1), 1e-12)
    return density[order].mean(1) / density
