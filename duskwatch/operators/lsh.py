"""Candidates by signs of random projections, found through bands, and re-ranked exactly.

Two signatures that differ in at most ``within`` of their bits differ in at most a ``bands``-th of them in one band. So a
query's band values, with every value that near to them, are looked up by an equality join: no pair within the radius
is lost, and none is compared that shares no band. Signatures are joined once each, however many rows have them, and of
each signature only as many rows go on as a query can keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from duskwatch.functions import vectors as V

from .steps import stored

#: Ten hashes of four sign bits, a fifth of them may differ, and the most candidates of a query.
BITS, WITHIN, MOST = 40, 8, 50
BANDS = 3
_PRIME = 2147483647


def plane_signs(bits: int, size: int) -> np.ndarray:
    """Planes of +1 and -1 by a rule that SQL can repeat."""
    x = np.arange(1, bits * size + 1, dtype=np.int64)
    h = x * 48271 % _PRIME
    h = (h * h + x) % _PRIME
    return np.where(h // 1024 % 2 == 1, 1.0, -1.0).reshape(bits, size)


def signature(vector: Column, bits: int, size: int) -> Column:
    """Bit i is set where the vector lies on the positive side of plane i."""
    planes, weight = plane_signs(bits, size).T, 1 << np.arange(bits, dtype=np.int64)

    @F.pandas_udf(LongType())
    def sign(v: pd.Series) -> pd.Series:
        return pd.Series((np.nan_to_num(np.stack(v.to_numpy())) @ planes > 0) @ weight if len(v) else [], dtype="int64")

    return sign(V.doubles(vector))


def band_cuts(bits: int, bands: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each band."""
    ends = [bits * i // bands for i in range(bands + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _flips(width: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)]


def _value(bits: Column, first: int, width: int) -> Column:
    return F.shiftright(bits, first).bitwiseAND((1 << width) - 1)


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def signature_pairs(left: DataFrame, right: DataFrame, bits: int = BITS, within: int = WITHIN, bands: int = BANDS) -> DataFrame:
    """(a, b, differing) for all signatures ``a`` of ``left`` and ``b`` of ``right`` with at most ``within`` differing bits; each once."""
    cuts, radius = band_cuts(bits, bands), within // bands
    probe = F.array(*[F.struct(F.lit(i).alias("band"), _value(F.col("a"), at, width).bitwiseXOR(flip).alias("value")) for i, (at, width) in enumerate(cuts) for flip in _flips(width, radius)])
    held = F.array(*[F.struct(F.lit(i).alias("band"), _value(F.col("b"), at, width).alias("value")) for i, (at, width) in enumerate(cuts)])
    asked = left.select("a").distinct().select("a", F.inline(probe))
    there = right.select("b").distinct().select("b", F.inline(held))
    met = asked.join(there, ["band", "value"])
    near = [_apart(_value(F.col("a"), at, width), _value(F.col("b"), at, width)) <= radius for at, width in cuts]
    earlier = F.lit(False)
    first = F.lit(False)  # a pair that meets in several bands counts in the first of them
    for i, close in enumerate(near):
        first = first | ((F.col("band") == i) & ~earlier)
        earlier = earlier | close
    apart = _apart(F.col("a"), F.col("b"))
    return met.filter(first & (apart <= within)).select("a", "b", apart.cast("int").alias("differing"))


def candidates(rows: DataFrame, queries: DataFrame, key: str, vector: str, size: int, bits: int = BITS, within: int = WITHIN, most: int | None = MOST, bands: int = BANDS) -> DataFrame:
    """(query, key, differing): of each query the ``most`` rows with the fewest differing bits, at most ``within``; ties by key.

    The query's own row is left out, null vectors have no signature. ``most`` None keeps all.
    """
    signed = stored(rows.filter(F.col(vector).isNotNull()).select(F.col(key), signature(F.col(vector), bits, size).alias("b")), "signatures")
    asked = stored(queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("query"), signature(F.col(vector), bits, size).alias("a")), "asked")
    pairs = signature_pairs(asked, signed, bits, within, bands)
    if most is not None:  # one more than can be kept, as one may be the query itself
        by_key = Window.partitionBy("b").orderBy(key)
        signed = signed.withColumn("__rn", F.row_number().over(by_key)).filter(F.col("__rn") <= most + 1).drop("__rn")
    met = pairs.join(signed, "b")
    if most is not None:
        near = Window.partitionBy("a").orderBy("differing", key)
        met = met.withColumn("__rn", F.row_number().over(near)).filter(F.col("__rn") <= most + 1).drop("__rn")
    found = asked.join(met, "a").filter(F.col(key) != F.col("query")).select("query", key, "differing")
    if most is None:
        return found
    own = Window.partitionBy("query").orderBy("differing", key)
    return found.withColumn("__rn", F.row_number().over(own)).filter(F.col("__rn") <= most).drop("__rn")


def behavioural_rows(a: np.ndarray, b: np.ndarray, slices: dict) -> np.ndarray:
    """Behavioural similarity of each row of ``a`` with the same row of ``b``."""
    def cosine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.sqrt((x * x).sum(1) * (y * y).sum(1))
        return np.clip(np.divide((x * y).sum(1), size, out=np.zeros(len(x)), where=size > 0), -1, 1), size > 0

    total = np.zeros(len(a))
    for name, ranges in slices.items():
        x, y = (np.concatenate([m[:, i:j] for i, j in ranges], axis=1) for m in (a, b))
        value, real = cosine(x, y)
        total += V.BSF_WEIGHTS[name] * np.where(real, (value + 1) / 2, 0.0)
    return np.where(a.any(1) & b.any(1), np.clip(total, 0, 1), 0.0)


def exact_nearest(pairs: DataFrame, rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, slices: dict | None = None) -> DataFrame:
    """(query, key, rank, distance, own, other): the k of each query's candidates with the least behavioural distance, ties by key."""
    slices = slices or V.BSF_SLICES
    kind = dict(rows.dtypes)[key]
    other = rows.select(key, V.doubles(F.col(vector)).alias("other"))
    own = queries.select(F.col(key).alias("query"), V.doubles(F.col(vector)).alias("own"))
    both = pairs.select("query", key).join(other, key).join(own, "query").select("query", key, "own", "other")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = (np.nan_to_num(batch.column(i).flatten().to_numpy().reshape(len(batch), -1)) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 - behavioural_rows(a, b, slices))], names=["query", key, "own", "other", "distance"])

    measured = both.mapInArrow(measure, f"query {kind}, `{key}` {kind}, own array<double>, other array<double>, distance double")
    w = Window.partitionBy("query").orderBy(F.round("distance", 12), key)
    return measured.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
