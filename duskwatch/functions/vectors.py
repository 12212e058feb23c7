"""Vector expressions on arrays of numbers, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slices of a behaviour vector by (first, end), their weights, and the category limits.
BSF_SLICES = {"structural": ((0, 64),), "temporal": ((84, 92),), "behavioural": ((64, 84), (92, 128))}
BSF_WEIGHTS = {"structural": 0.3, "temporal": 0.2, "behavioural": 0.5}
BSF_LIMITS = (0.85, 0.60)
#: The same three parts for vectors of 64 numbers.
BSF_SLICES_64 = {"structural": ((0, 32),), "temporal": ((42, 46),), "behavioural": ((32, 42), (46, 64))}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clipped to -1..1; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def mapped_cosine(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise((cosine(a, b) + 1) / 2)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)


def weighted_cosine(a: Column, b: Column, weights: Column) -> Column:
    scaled = lambda v: F.zip_with(v, weights, lambda x, w: x * F.sqrt(w))
    return cosine(scaled(a), scaled(b))


def normalised(v: Column, power: int = 2) -> Column:
    """Vector of norm 1 by the first or second norm; a zero vector stays as it is."""
    size = norm(v) if power == 2 else F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return F.when(size == 0, v).otherwise(F.transform(v, lambda x: x / size))


def min_max(v: Column) -> Column:
    """Values scaled to 0..1 within the vector; zeros if all are equal."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when(high == low, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: (x - low) / (high - low)))


def part(v: Column, ranges: tuple[tuple[int, int], ...]) -> Column:
    return F.concat(*[F.slice(v, a + 1, b - a) for a, b in ranges])


def bsf_parts(a: Column, b: Column, slices: dict | None = None) -> dict[str, Column]:
    slices = slices or BSF_SLICES
    return {name: mapped_cosine(part(a, r), part(b, r)) for name, r in slices.items()}


def bsf(a: Column, b: Column, slices: dict | None = None, weights: dict | None = None) -> Column:
    """Weighted sum of the mapped cosines of the slices, in 0..1; 0 if either whole vector is zero."""
    weights = weights or BSF_WEIGHTS
    total = sum((F.lit(weights[n]) * c for n, c in bsf_parts(a, b, slices).items()), F.lit(0.0))
    return F.when(norm(a) * norm(b) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def similarity_category(s: Column) -> Column:
    high, medium = BSF_LIMITS
    return F.when(s >= high, F.lit("high")).when(s >= medium, F.lit("medium")).otherwise(F.lit("low"))


def mean_abs(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.abs(x)) / F.size(v)


def variance(v: Column) -> Column:
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    return bound(mean, lambda m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))) / n


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct elements over all distinct elements; 0 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)
