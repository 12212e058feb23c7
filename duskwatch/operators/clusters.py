"""Density clusters, seeds far apart, and clusters around seeds, over vectors spread over tasks.

Only seeds go to every task: their number is a parameter. Neighbours within an angle are found by matrix products of pairs of
blocks of bounded size; angles to seeds tell which rows of them can't be near. A pair of blocks hands on sums by row and
trees, never its near pairs. Equal vectors count as one with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions import vectors as V

from .centrality import components
from .similarity import centroid
from .steps import stored

#: Vectors of a block at most, blocks that few vectors are dealt to, and how many rows of one side meet how many runs of the other at once.
BLOCK, SPREAD, RUN, RUNS = 32_768, 8, 128, 32


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _distances(x: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - s) ** 2).sum(1)) for s in seeds], axis=1)


def farthest_first(rows: DataFrame, key: str, vector: str, k: int) -> list[tuple]:
    """(key, vector) of up to k seeds: the smallest key, then ever the row farthest from all seeds so far; ties by the smallest key.

    One pass over the rows for each seed, which hands on one row a batch. Rows that equal a seed are no further seed.
    """
    base = rows.filter(F.col(vector).isNotNull()).select(F.col(key), V.doubles(F.col(vector)).alias("v"))
    kind, start = dict(base.dtypes)[key], base.orderBy(key).limit(1).collect()
    seeds = [(r[0], r[1]) for r in start]
    while seeds and len(seeds) < k:
        held = np.array([v for _, v in seeds], float)

        def best(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    far = np.round(_distances(_matrix(batch.column(1)), held).min(1), 9)
                    keys = batch.column(0).to_pylist()
                    top = min(np.flatnonzero(far == far.max()), key=lambda i: keys[i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([top])), batch.column(1).take(pa.array([top])), pa.array([far[top]])], names=[key, "v", "far"])

        found = base.mapInArrow(best, f"`{key}` {kind}, v array<double>, far double").orderBy(F.desc("far"), key).limit(1).collect()
        if not found or found[0]["far"] <= 0:
            break
        seeds.append((found[0][0], found[0]["v"]))
    return seeds


def nearest_seed(rows: DataFrame, key: str, vector: str, seeds: list, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, v, cluster): the number of the nearest seed of each row, ties by the smaller number."""
    held = np.array(seeds, float)
    base = rows.filter(F.col(vector).isNotNull()).select(key, *also, V.doubles(F.col(vector)).alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = np.round(_distances(_matrix(batch.column(batch.num_columns - 1)), held), 9).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "cluster"])

    return base.mapInArrow(assign, ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", cluster int")


def kmeans_from(rows: DataFrame, key: str, vector: str, seeds: list, iterations: int = 20) -> list[list[float]]:
    """Centres after moving seeds to the mean of their rows, up to ``iterations`` times; a seed without rows stays."""
    centres = [list(map(float, s)) for s in seeds]
    for _ in range(iterations):
        means = {r["cluster"]: r["centroid"] for r in centroid(nearest_seed(rows, key, vector, centres), "cluster", "v").collect()}
        moved = [means.get(i, c) for i, c in enumerate(centres)]
        if moved == centres:
            break
        centres = moved
    return centres


def near_rows(x: np.ndarray, y: np.ndarray, eps: float, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y) of all within ``eps`` of each other by cosine distance, some rows of ``x`` at a time; none is zero.

    Products of short floats find what may be near; what they leave open is settled in doubles. Runs of rows whose angles to
    a seed differ by more than that of ``eps`` are not compared: by the triangle inequality none of them is near.
    """
    a, b, seeds = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y, seeds))
    angle, least, slack = float(np.arccos(np.clip(1 - eps, -1, 1))) + 1e-6, 1 - eps, 2e-7 * max(64, x.shape[1])
    far = [np.arccos(np.clip(m @ seeds.T, -1, 1)) for m in (a, b)]
    order = [np.lexsort((f.min(1), f.argmin(1))) for f in far]
    cuts = [np.arange(0, len(o), RUN) for o in order]
    low, high = ([f.reduceat(d[o], c) for d, o, c in zip(far, order, cuts)] for f in (np.minimum, np.maximum))
    a, b = a.astype(np.float32), b.astype(np.float32)
    for i, at in enumerate(cuts[0]):
        mine = order[0][at : at + RUN]
        met = np.flatnonzero((np.maximum(low[0][i] - high[1], low[1] - high[0][i]) <= angle).all(1))
        for part in (met[k : k + RUNS] for k in range(0, len(met), RUNS)):
            theirs = np.concatenate([order[1][cuts[1][j] : cuts[1][j] + RUN] for j in part])
            likeness = a[mine] @ b[theirs].T
            i_at, j_at = np.nonzero(likeness >= least - slack)
            rows, others, held = mine[i_at], theirs[j_at], np.ones(len(i_at), bool)
            unsure = np.flatnonzero(likeness[i_at, j_at] <= least + slack)
            for some in (unsure[k : k + 16_384] for k in range(0, len(unsure), 16_384)):
                p, q = x[rows[some]], y[others[some]]
                held[some] = 1 - (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1)) <= eps + 1e-12
            yield rows[held], others[held]


def _trees(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, of each row the smallest row of its tree, after links a-b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


class _Block:
    """The rows of one pair of blocks, or of one block with itself."""

    def __init__(self, table: pa.Table):
        held = {c: table.column(c).combine_chunks() for c in table.column_names}
        self.node, self.vectors = held["node"], _matrix(held["v"])
        self.weight, self.side, self.core = (held[c].to_numpy(zero_copy_only=False) if c in held else None for c in ("weight", "side", "core"))

    def near(self, eps: float, seeds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows that are near, any two once."""
        first, second = np.flatnonzero(self.side < 2), np.flatnonzero(self.side != 1)
        if len(first) and len(second):
            for i, j in near_rows(self.vectors[first], self.vectors[second], eps, seeds):
                once = first[i] < second[j] if self.side[0] == 0 else slice(None)
                yield first[i][once], second[j][once]


def meeting(rows: DataFrame, n: int):
    """Rows by pairs of blocks of at most about ``BLOCK`` of ``n`` rows; ``side`` is 0 where a block meets itself, else 1 or 2."""
    blocks = max(1, min(SPREAD, -(-n // 2048)), -(-n // BLOCK))
    own, other = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"), F.col("__other")
    dealt = rows.withColumns({"__own": own, "__other": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    side = F.when(F.col("__own") == other, 0).when(F.col("__own") < other, 1).otherwise(2)
    pair = F.least("__own", other) * F.lit(blocks) + F.greatest("__own", other)
    return dealt.select(pair.alias("pair"), side.alias("side"), *rows.columns).repartition(min(2000, blocks * (blocks + 1)), "pair").groupBy("pair")


def weights_around(rows: DataFrame, n: int, eps: float, seeds: np.ndarray) -> DataFrame:
    """(node, more): the weight of all other rows within ``eps``, for rows that have such."""
    def one(table: pa.Table) -> pa.Table:
        block = _Block(table)
        more = np.zeros(len(block.node))
        for i, j in block.near(eps, seeds):
            more += np.bincount(i, block.weight[j], len(more)) + np.bincount(j, block.weight[i], len(more))
        at = np.flatnonzero(more)
        return pa.table({"node": block.node.take(pa.array(at)), "more": pa.array(more[at].astype(np.int64))})

    return meeting(rows, n).applyInArrow(one, f"node {dict(rows.dtypes)['node']}, more long").groupBy("node").agg(F.sum("more").alias("more"))


def core_links(rows: DataFrame, n: int, eps: float, seeds: np.ndarray) -> DataFrame:
    """(a, b, inner): links with the same components of cores as all pairs within ``eps``, and of others a core of each component near.

    Of each pair of blocks the cores go on as trees, so links grow with the rows of the pairs and not with the near pairs.
    """
    def one(table: pa.Table) -> pa.Table:
        block = _Block(table)
        n, label, edge = len(block.node), np.arange(len(block.node)), []
        for i, j in block.near(eps, seeds):
            both = block.core[i] & block.core[j]
            label = _trees(label, i[both], j[both])
            mixed = block.core[i] != block.core[j]
            i, j = i[mixed], j[mixed]
            edge.append(np.unique(np.where(block.core[i], j, i) * n + np.where(block.core[i], i, j)))
        outer, core = np.divmod(np.concatenate([np.zeros(0, np.int64), *edge]), max(n, 1))
        outer, core = np.divmod(np.unique(outer * n + label[core]), max(n, 1))
        inner = np.flatnonzero(label != np.arange(n))
        a, b = np.concatenate([inner, outer]), np.concatenate([label[inner], core])
        return pa.table({"a": block.node.take(pa.array(a)), "b": block.node.take(pa.array(b)), "inner": pa.array(np.arange(len(a)) < len(inner))})

    kind = dict(rows.dtypes)["node"]
    return meeting(rows, n).applyInArrow(one, f"a {kind}, b {kind}, inner boolean")


def dbscan(rows: DataFrame, key: str, vector: str, eps: float, min_points: int, n_seeds: int = 32) -> DataFrame:
    """(key, cluster): clusters by density under cosine distance, named by their smallest core key; null for noise.

    A core row has ``min_points`` rows within ``eps``, itself counted. Rows that are near a core but no core belong to
    the cluster with the smallest name among those near. Zero and null vectors are noise. Equal vectors are compared once.
    """
    known = rows.select(key, V.doubles(F.col(vector)).alias("v"))
    real = known.filter(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    alike = stored(real.groupBy("v").agg(F.min(key).alias("node"), F.count("*").alias("weight")), "alike")
    n = alike.count()
    if not n:
        return known.select(key, F.lit(None).cast(dict(rows.dtypes)[key]).alias("cluster"))
    seeds = np.array([r.v for r in alike.orderBy(F.xxhash64("node"), "node").limit(n_seeds).collect()], float)
    weight = alike.select("node", "weight")
    around = weights_around(alike, n, eps, seeds)
    known_cores = weight.join(around, "node", "left").select("node", (F.col("weight") + F.coalesce("more", F.lit(0)) >= min_points).alias("core"))
    held = stored(alike.join(known_cores, "node").select("node", "v", "core"), "cores")
    links = stored(core_links(held, n, eps, seeds), "links")
    inner = links.filter("inner").select(F.lit(0).alias("g"), F.col("a").alias("src"), F.col("b").alias("dst"))
    named = components(held.filter("core").select(F.lit(0).alias("g"), "node"), inner, "g").select("node", "component")
    border = links.filter("not inner").join(named.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("reached"))
    found = weight.select("node").join(named, "node", "left").join(border, "node", "left").select("node", F.coalesce("component", "reached").alias("cluster"))
    members = real.join(alike.select("v", "node"), "v").join(found, "node").select(key, "cluster")
    return known.select(key).join(members, key, "left")


def campaigns(clustered: DataFrame, rows: DataFrame, key: str, vector: str, kind: str, at: str, techniques: str | None = None, share: float = 0.3, most: int = 10) -> DataFrame:
    """One row per cluster: members, dominant kind (ties by name), first and last time, mean vector, frequent techniques.

    ``techniques`` names an array; a technique that is listed for at least ``share`` of the members counts, the ``most``
    frequent of them first, ties by name.
    """
    joined = stored(clustered.filter("cluster is not null").join(rows, key), "members")
    out = joined.groupBy("cluster").agg(F.count("*").alias("members"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    kinds = joined.groupBy("cluster", F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    top = kinds.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "kind"))).filter("rn = 1").select("cluster", "kind")
    out = out.join(top, "cluster").join(centroid(joined, "cluster", vector), "cluster")
    if techniques is None:
        return out
    counts = joined.select("cluster", F.explode(techniques).alias("technique")).groupBy("cluster", "technique").agg(F.count("*").alias("n")).join(out.select("cluster", "members"), "cluster")
    frequent = counts.filter(F.col("n") >= share * F.col("members")).withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "technique"))).filter(F.col("rn") <= most)
    listed = frequent.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "technique"))), lambda x: x["technique"]).alias("techniques"))
    return out.join(listed, "cluster", "left").withColumn("techniques", F.coalesce("techniques", F.array().cast("array<string>")))
