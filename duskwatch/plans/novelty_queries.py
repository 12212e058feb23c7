"""Queries of candidates by signature, exact neighbours and novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import vectors as V
from duskwatch.operators import lsh, novelty

from .registry import register
from .vector_queries import _E, _bsf_sql

_QUERY = "vec_id % 50 = 0"
_SIGNED = f"""
    {_E}, raw AS (SELECT i, j, (i * 64 + j + 1)::BIGINT AS x FROM range(40) a(i), range(64) b(j)),
    planes AS (SELECT i, list(CASE WHEN ((x * 48271 % 2147483647) * (x * 48271 % 2147483647) + x) % 2147483647 // 1024 % 2 = 1 THEN 1e0 ELSE -1e0 END ORDER BY j) AS p FROM raw GROUP BY i),
    g AS (SELECT vec_id, sum(CASE WHEN list_dot_product(v, p) > 0 THEN 1::BIGINT << i ELSE 0 END)::BIGINT AS bits FROM e, planes GROUP BY vec_id),
    cand AS (
        SELECT a.vec_id AS query, b.vec_id, bit_count(xor(a.bits, b.bits))::INTEGER AS differing FROM g a JOIN g b ON a.vec_id <> b.vec_id AND bit_count(xor(a.bits, b.bits)) <= 8 WHERE a.vec_id % 50 = 0
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.bits, b.bits)), b.vec_id) <= 50)
"""
_NEAR = f"""
    {_SIGNED}, near AS (
        SELECT query, vec_id, distance, row_number() OVER (PARTITION BY query ORDER BY round(distance, 12), vec_id) AS rank
        FROM (SELECT c.query, c.vec_id, 1 - greatest(0e0, least(1e0, {_bsf_sql('a.v', 'b.v')})) AS distance FROM cand c JOIN e a ON a.vec_id = c.query JOIN e b ON b.vec_id = c.vec_id)
        QUALIFY rank <= 5)
"""
#: Each query's points are itself and its neighbours; with up to five neighbours all others are near.
_NOVELTY = f"""
    {_NEAR}, ids AS (SELECT vec_id AS query FROM e WHERE vec_id % 50 = 0),
    points AS (SELECT query, query AS p, 0 AS rank FROM ids UNION ALL SELECT query, vec_id, rank FROM near),
    far AS (SELECT a.query, a.p, b.p AS o, list_distance(x.v, y.v) AS d FROM points a JOIN points b ON a.query = b.query AND a.p <> b.p JOIN e x ON x.vec_id = a.p JOIN e y ON y.vec_id = b.p),
    kd AS (SELECT query, p, max(d) AS kd FROM far GROUP BY ALL),
    lrd AS (SELECT f.query, f.p, 1 / greatest(avg(greatest(f.d, k.kd)), 1e-12) AS density FROM far f JOIN kd k ON k.query = f.query AND k.p = f.o GROUP BY ALL),
    lof AS (SELECT f.query, avg(l.density) / any_value(own.density) AS lof FROM far f JOIN lrd l ON l.query = f.query AND l.p = f.o JOIN lrd own ON own.query = f.query AND own.p = f.p WHERE f.p = f.query GROUP BY 1),
    agg AS (SELECT query, count(*) AS n, min(distance) AS nearest, max(distance) AS last, avg(distance) AS mean FROM near GROUP BY 1),
    facts AS (SELECT i.query, coalesce(n, 0) AS n, CASE WHEN n >= 3 THEN lof WHEN n >= 2 THEN nearest END AS lof, CASE WHEN n >= 1 THEN least(1e0, 0.6e0 * last + 0.4e0 * mean) END AS d FROM ids i LEFT JOIN agg USING (query) LEFT JOIN lof USING (query)),
    parts AS (SELECT *, CASE WHEN lof IS NULL THEN 1e0 WHEN lof > 1 THEN least((lof - 1) / 2, 1e0) ELSE 0e0 END AS f, least(1.2e0 * d, 1e0) AS topology FROM facts),
    scored AS (SELECT query AS vec_id, n, lof, CASE WHEN n = 0 THEN 1e0 ELSE greatest(0e0, least(1e0,
        0.6e0 * sqrt((d * d + f * f + topology * topology + 0.64e0 * d * d + 0.81e0 * f * f) / 5) + 0.4e0 * (0.3e0 * d + 0.25e0 * f + 0.2e0 * topology + 0.15e0 * 0.8e0 * d + 0.1e0 * 0.9e0 * f))) END AS score FROM parts)
"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows, rows.filter(_QUERY)


@register("lsh_candidates", f"WITH {_SIGNED} SELECT query, vec_id, differing FROM cand")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of 40 bits, at most 8 of them apart, the best 50 of each query."""
    return lsh.candidates(*_tables(spark, sf_dir), "vec_id", "embedding", 64)


@register("lsh_neighbours", f"WITH {_NEAR} SELECT query, vec_id, rank::INTEGER AS rank, round(distance, 6) AS distance FROM near")
def lsh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates the five nearest by exact behavioural distance."""
    found = novelty.neighbours(*_tables(spark, sf_dir), "vec_id", "embedding", 64, V.BSF_SLICES_64)
    return found.select("query", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.score_novelty(*_tables(spark, sf_dir), "vec_id", "embedding", 64, V.BSF_SLICES_64, novelty.REASONS_64)


@register(
    "novelty_scores",
    f"""
    WITH {_NOVELTY} SELECT vec_id, round(score, 6) AS score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS category, round(lof, 5) AS lof, n AS n_neighbours,
      CASE WHEN n = 0 THEN 'no_candidates_found' ELSE 'neighbours' END AS reason FROM scored
    """,
)
def novelty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of every query vector; an outlier factor that is infinite shows as null."""
    lof = F.when(F.col("lof") < float("inf"), F.round("lof", 5))
    return _scored(spark, sf_dir).select("vec_id", F.round("score", 6).alias("score"), "category", lof.alias("lof"), "n_neighbours", "reason")


@register("novel_vectors", f"WITH {_NOVELTY} SELECT vec_id, round(score, 6) AS score FROM scored WHERE score >= 0.8")
def novel_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.novel_items(_scored(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


def _mean(ranges: tuple[tuple[int, int], ...]) -> str:
    return "(" + " + ".join(f"list_avg(off[{a + 1}:{b}])" for a, b in ranges) + f") / {len(ranges)}"


@register(
    "novelty_reasons",
    f"""
    WITH {_NEAR}, u AS (SELECT query, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near JOIN e USING (vec_id)), m AS (SELECT query, i, avg(x) AS x FROM u GROUP BY ALL),
    c AS (SELECT query, list(x ORDER BY i) AS mean FROM m GROUP BY query), o AS (SELECT query, list_transform(range(1, 65), lambda i: abs(v[i] - mean[i])) AS off FROM c JOIN e ON e.vec_id = c.query),
    r AS (SELECT query, {', '.join(f'{_mean(r)} AS {n}' for n, r in novelty.REASONS_64.items())}, list_avg(off) AS overall FROM o)
    SELECT query AS vec_id, {', '.join(f'round({n}, 6) AS {n}' for n in [*novelty.REASONS_64, 'overall'])}, round(sqrt(({' + '.join(f'{n} * {n}' for n in novelty.REASONS_64)}) / 5), 6) AS p_norm FROM r
    """,
)
def novelty_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which parts each query vector differs from its neighbours."""
    rows = _scored(spark, sf_dir).filter("n_neighbours > 0")
    return rows.select("vec_id", *[F.round(F.col("parts")[n], 6).alias(n) for n in [*novelty.REASONS_64, "overall", "p_norm"]])
