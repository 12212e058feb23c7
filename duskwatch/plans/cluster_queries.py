"""Queries of density clusters, seeds far apart, seeded k-means, and words in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import clusters, matching

from .registry import register
from .vector_queries import _COS, _E

#: Wide enough that the vectors of the tables form clusters.
_EPS, _MIN, _K, _ROUNDS = 0.62, 3, 6, 4

_CLUSTERS = f"""
    WITH RECURSIVE {_E}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE 1 - {_COS} <= {_EPS} + 1e-12),
    core AS (SELECT a FROM p GROUP BY a HAVING count(*) + 1 >= {_MIN}), l AS (SELECT a, b FROM p WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
    r AS (SELECT a AS node, a AS root FROM core UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node), named AS (SELECT node, min(root) AS cluster FROM r GROUP BY node),
    border AS (SELECT p.a AS node, min(cluster) AS cluster FROM p JOIN named ON named.node = p.b GROUP BY 1),
    found AS (SELECT e.vec_id, coalesce(n.cluster, o.cluster) AS cluster FROM e LEFT JOIN named n ON n.node = e.vec_id LEFT JOIN border o ON o.node = e.vec_id)
"""


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@register("density_clusters", f"{_CLUSTERS} SELECT vec_id, cluster FROM found")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.dbscan(_e(spark, sf_dir), "vec_id", "embedding", _EPS, _MIN)


@register(
    "clustered_campaigns",
    f"""
    {_CLUSTERS}, m AS (SELECT f.cluster, e.* FROM found f JOIN e USING (vec_id) WHERE cluster IS NOT NULL),
    k AS (SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS rn FROM m GROUP BY cluster, label),
    c AS (SELECT cluster, i, avg(x) AS mean FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM m) GROUP BY ALL), s AS (SELECT cluster, sum(mean * i) AS digest FROM c GROUP BY cluster)
    SELECT m.cluster, count(*) AS members, any_value(k.label) AS kind, min(vec_id) AS first_seen, max(vec_id) AS last_seen, round(any_value(digest), 6) AS digest
    FROM m JOIN k ON k.cluster = m.cluster AND rn = 1 JOIN s ON s.cluster = m.cluster GROUP BY m.cluster
    """,
)
def clustered_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign rows of the clusters; the mean vector shows as one number."""
    rows = _e(spark, sf_dir).withColumn("seen", F.col("vec_id"))
    found = clusters.campaigns(clusters.dbscan(rows, "vec_id", "embedding", _EPS, _MIN), rows, "vec_id", "embedding", "label", "seen")
    digest = F.aggregate(F.zip_with("centroid", F.sequence(F.lit(1), F.size("centroid")), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return found.select("cluster", "members", "kind", "first_seen", "last_seen", F.round(digest, 6).alias("digest"))


_SEEDS = ", ".join(
    ["s0 AS MATERIALIZED (SELECT vec_id, v, 0 AS i FROM e ORDER BY vec_id LIMIT 1)"]
    + [f"s{n} AS MATERIALIZED (SELECT * FROM s{n - 1} UNION ALL (SELECT e.vec_id, any_value(e.v), {n} FROM e, s{n - 1} s GROUP BY e.vec_id ORDER BY min(round(list_distance(e.v, s.v), 9)) DESC, e.vec_id LIMIT 1))" for n in range(1, _K)]
)


@register("farthest_seeds", f"WITH {_E}, {_SEEDS} SELECT vec_id, i AS place FROM s{_K - 1}")
def farthest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds far apart, in the order in which they were found."""
    seeds = clusters.farthest_first(_e(spark, sf_dir), "vec_id", "embedding", _K)
    return spark.createDataFrame([(k, i) for i, (k, _) in enumerate(seeds)], "vec_id long, place int")


_MOVED = ", ".join(
    f"""a{n} AS MATERIALIZED (SELECT e.vec_id, any_value(e.v) AS v, arg_min(c.i, [round(list_distance(e.v, c.v), 9), c.i]) AS cluster FROM e, c{n} c GROUP BY e.vec_id),
    c{n + 1} AS MATERIALIZED (SELECT cluster AS i, list(x ORDER BY pos) AS v FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{n}) GROUP BY ALL) GROUP BY cluster
      UNION ALL SELECT i, v FROM c{n} WHERE i NOT IN (SELECT cluster FROM a{n}))"""
    for n in range(_ROUNDS)
)


@register(
    "kmeans_seeded",
    f"WITH {_E}, {_SEEDS}, c0 AS (SELECT i, v FROM s{_K - 1}), {_MOVED} SELECT e.vec_id, arg_min(c.i, [round(list_distance(e.v, c.v), 9), c.i])::INTEGER AS cluster FROM e, c{_ROUNDS} c GROUP BY e.vec_id",
)
def kmeans_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means from seeds far apart."""
    rows = _e(spark, sf_dir)
    centres = clusters.kmeans_from(rows, "vec_id", "embedding", [v for _, v in clusters.farthest_first(rows, "vec_id", "embedding", _K)], _ROUNDS)
    return clusters.nearest_seed(rows, "vec_id", "embedding", centres).select("vec_id", "cluster")


@register(
    "indicator_correlation",
    """
    WITH i AS (SELECT DISTINCT unnest(string_split(lower(concat(p_name, ' ', p_type, ' ', p_brand)), ' ')) AS indicator FROM part), b AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS observed FROM benchmark)
    SELECT indicator, observed FROM i JOIN b ON contains(observed, indicator) OR contains(indicator, observed) WHERE indicator <> '' AND observed <> ''
    """,
)
def indicator_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of parts and of benchmark items of which one occurs in the other."""
    words = lambda c: F.explode(F.split(F.lower(c), " "))
    left = spark.read.parquet(f"{sf_dir}/part.parquet").select(words(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("indicator"))
    right = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words(F.col("text")).alias("observed"))
    return matching.either_contains(left, right, "indicator", "observed")
