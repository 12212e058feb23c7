"""Queries over vectors and graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.functions import scoring as S
from duskwatch.functions import vectors as V
from duskwatch.operators import graphs, neighbours, similarity, windows

from .registry import register
from .telemetry import TELEMETRY, telemetry

_QUERY = "vec_id % 50 = 0"
_D = "CAST({} AS DOUBLE[])"
_COS = "greatest(-1e0, least(1e0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))))"
_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@register(
    "knn_cosine",
    f"""
    WITH {_E}, p AS (SELECT a.vec_id AS query, b.vec_id, 1 - {_COS} AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id) AS rank FROM p)
    SELECT query, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= 5
    """,
)
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    return similarity.nearest(rows, rows.filter(_QUERY), "vec_id", "embedding", 5).select("query", "vec_id", F.round("distance", 6).alias("distance"))


@register(
    "knn_euclidean",
    f"""
    WITH {_E}, p AS (SELECT a.vec_id AS query, b.vec_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM p)
    SELECT query, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= 5
    """,
)
def knn_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    return similarity.nearest(rows, rows.filter(_QUERY), "vec_id", "embedding", 5, "euclidean").select("query", "vec_id", F.round("distance", 6).alias("distance"))


@register(
    "manhattan_distances",
    f"""
    WITH {_E} SELECT a.vec_id AS query, b.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.v[i] - b.v[i]))), 6) AS distance
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    """,
)
def manhattan_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    return similarity.distances(rows, rows.filter(_QUERY), "vec_id", "embedding", "manhattan").select("query", "vec_id", F.round("distance", 6).alias("distance"))


@register(
    "cosine_threshold",
    f"WITH {_E} SELECT a.vec_id AS query, b.vec_id, round({_COS}, 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND {_COS} >= 0.5",
)
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    return similarity.at_least(rows, rows.filter(_QUERY), "vec_id", "embedding", 0.5).select("query", "vec_id", F.round("similarity", 6).alias("similarity"))


def _bsf_sql(a: str, b: str) -> str:
    cut = lambda v, r: "list_concat(" + ", ".join(f"{v}[{x + 1}:{y}]" for x, y in r) + ")" if len(r) > 1 else f"{v}[{r[0][0] + 1}:{r[0][1]}]"
    part = lambda r: f"((list_dot_product({cut(a, r)}, {cut(b, r)}) / (sqrt(list_dot_product({cut(a, r)}, {cut(a, r)})) * sqrt(list_dot_product({cut(b, r)}, {cut(b, r)})))) + 1) / 2"
    return "(" + " + ".join(f"{V.BSF_WEIGHTS[n]}e0 * {part(r)}" for n, r in V.BSF_SLICES_64.items()) + ")"


@register(
    "bsf_similarity",
    f"WITH {_E} SELECT a.vec_id AS query, b.vec_id, round({_bsf_sql('a.v', 'b.v')}, 6) AS similarity FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0",
)
def bsf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    d = similarity.distances(rows, rows.filter(_QUERY), "vec_id", "embedding", "behavioural")
    return d.select("query", "vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@register(
    "signature_match",
    f"""
    WITH {_E}, c AS (SELECT label, list(v) AS vs FROM e GROUP BY label), s AS (SELECT label AS signature, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda x: x[i]))) AS v FROM c),
    p AS (SELECT a.vec_id, b.signature, {_bsf_sql('a.v', 'b.v')} AS similarity FROM e a, s b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, signature) AS rn FROM p WHERE similarity > 0.7)
    SELECT vec_id, signature, round(similarity, 6) AS similarity FROM r WHERE rn = 1
    """,
)
def signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    signatures = similarity.centroid(rows, "label", "embedding").select(F.col("label").alias("signature"), "centroid")
    return similarity.best_signature(rows, signatures.withColumnRenamed("centroid", "embedding"), "vec_id", "embedding", "signature", 0.7).select(
        "vec_id", "signature", F.round("similarity", 6).alias("similarity")
    )


@register(
    "cluster_centroids",
    f"WITH {_E}, u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e) SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean FROM u GROUP BY ALL",
)
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = similarity.centroid(_e(spark, sf_dir), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("mean"))


@register(
    "vector_norms",
    f"""
    WITH {_E} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS l2, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1,
      round(list_sum(list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)))), 6) AS scaled_sum, round(list_sum(list_transform(v, lambda x: abs(x))) / 64, 6) AS mean_abs,
      round(list_var_pop(v), 6) AS variance FROM e
    """,
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.doubles(F.col("embedding"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)
    return _e(spark, sf_dir).select(
        "vec_id",
        F.round(V.norm(v), 6).alias("l2"),
        F.round(total(F.transform(v, F.abs)), 6).alias("l1"),
        F.round(total(V.min_max(v)), 6).alias("scaled_sum"),
        F.round(V.mean_abs(v), 6).alias("mean_abs"),
        F.round(V.variance(v), 6).alias("variance"),
    )


def _scored_sql(asked: str) -> str:
    return f"""
    {_E}, p AS (SELECT a.vec_id, b.vec_id AS other, a.label, 1 - (({_COS}) + 1) / 2 AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id{asked}),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS rn FROM p),
    s AS (SELECT vec_id, max(label) AS label, 1 - min(d) AS sim, least(1e0, 0.6e0 * max(d) + 0.4e0 * avg(d)) AS nov, count(*) FILTER (WHERE d < 0.3) AS matches FROM r WHERE rn <= 5 GROUP BY vec_id)
"""


_SCORED = _scored_sql(f" WHERE a.{_QUERY}")


def _measured(near: DataFrame, rows: DataFrame) -> DataFrame:
    """Likeness, novelty, matches and label of each vector from its five nearest (query, d)."""
    s = near.groupBy(F.col("query").alias("vec_id")).agg(
        (1 - F.min("d")).alias("sim"), S.distance_novelty(F.max("d"), F.avg("d")).alias("nov"), F.count_if(F.col("d") < 0.3).alias("matches")
    )
    return s.join(rows.select("vec_id", "label"), "vec_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir)
    # rows whose d is the same to nine places are equal, so all that may round to the fifth's go on
    near = similarity.near_enough(rows, rows.filter(_QUERY), "vec_id", "embedding", 5, slack=4e-9).withColumn("d", F.col("distance") / 2)
    w = Window.partitionBy("query").orderBy(F.round("d", 9), "vec_id")
    return _measured(near.withColumn("rn", F.row_number().over(w)).filter("rn <= 5"), rows)


@register(
    "confidence_scores",
    f"""
    WITH {_SCORED}, q AS (SELECT *, greatest(0e0, least(1e0, 0.6e0 * sim + 0.4e0 * (1 - nov))) AS raw FROM s),
    b AS (SELECT *, (CASE WHEN raw < 0.3 THEN 0.5e0 * raw WHEN raw > 0.7 THEN 0.5e0 + 0.5e0 * (raw - 0.7e0) ELSE raw END) * (1 - 0.4e0 * nov * (1 - sim)) AS t FROM q),
    c AS (SELECT *, greatest(0e0, least(1e0, CASE WHEN matches > 0 THEN t + (1 - t) * 0.2e0 * (1 - exp(-0.06e0 * matches)) ELSE t END)) AS confidence FROM b)
    SELECT vec_id, round(sim, 6) AS sim, round(nov, 6) AS nov, round(confidence, 6) AS confidence,
      round(0.5e0 * 0.5e0 * (CASE WHEN confidence < 0.2 OR confidence > 0.8 THEN 1.3e0 ELSE 1e0 END) * (CASE WHEN nov > 0.7 THEN 1.3e0 ELSE 1e0 END), 6) AS half_width FROM c
    """,
)
def confidence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, k, one = F.col("sim"), F.col("nov"), F.lit(60), F.lit(1.0)
    c = _scored(spark, sf_dir).withColumn("confidence", S.confidence(s, n, F.col("matches"), k, one))
    half = S.interval_half_width(F.lit(0.5), F.col("confidence"), k, one, n)
    return c.select("vec_id", F.round(s, 6).alias("sim"), F.round(n, 6).alias("nov"), F.round("confidence", 6).alias("confidence"), F.round(half, 6).alias("half_width"))


@register(
    "risk_scores",
    f"""
    WITH {_scored_sql('')}, b AS (SELECT *, CASE label % 3 WHEN 0 THEN 'APT' WHEN 1 THEN 'Malware' ELSE 'Benign' END AS threat, 0.3e0 * sim + 0.4e0 * nov + 0.3e0 * 0.6e0 AS base FROM s),
    w AS (SELECT *, base * CASE threat WHEN 'APT' THEN 1.2e0 WHEN 'Malware' THEN 1.0e0 ELSE 0.3e0 END AS x FROM b),
    n AS (SELECT *, CASE WHEN nov > 0.8 THEN x * (1 + 0.25e0 * least(1e0, (nov - 0.8e0) / 0.2e0)) ELSE x END AS y FROM w),
    z AS (SELECT vec_id, threat, greatest(0e0, least(y, CASE WHEN threat = 'Benign' THEN 0.15e0 ELSE 1e0 END)) AS risk FROM n)
    SELECT vec_id, threat, round(risk, 6) AS risk, CASE WHEN risk >= 0.85 THEN 'CRITICAL' WHEN risk >= 0.7 THEN 'HIGH' WHEN risk >= 0.5 THEN 'MEDIUM' WHEN risk >= 0.3 THEN 'LOW' ELSE 'MINIMAL' END AS level FROM z
    """,
)
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's risk from its five nearest among all others."""
    e = _e(spark, sf_dir)
    near = neighbours.nearest_of_all(e, "vec_id", "embedding", 5).withColumn("d", F.col("distance") / 2)
    rows = _measured(near, e).withColumn("threat", F.when(F.col("label") % 3 == 0, "APT").when(F.col("label") % 3 == 1, "Malware").otherwise("Benign"))
    no = F.lit(False)
    rows = rows.withColumn("risk", S.risk(F.col("sim"), F.col("nov"), F.lit(0.6), F.col("threat"), no, no))
    return rows.select("vec_id", "threat", F.round("risk", 6).alias("risk"), S.risk_level(F.col("risk")).alias("level"))


@register(
    "novelty_categories",
    f"WITH {_SCORED} SELECT CASE WHEN nov >= 0.8 THEN 'high' WHEN nov >= 0.5 THEN 'medium' ELSE 'low' END AS category, count(*) AS n FROM s GROUP BY 1",
)
def novelty_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(S.novelty_category(F.col("nov")).alias("category")).agg(F.count("*").alias("n"))


@register(
    "local_outliers",
    f"""
    WITH {_E}, ids AS (SELECT vec_id AS query, v FROM e WHERE vec_id % 50 = 0),
    near AS (SELECT ids.query, e.vec_id AS p, 1 - list_cosine_similarity(ids.v, e.v) AS distance, row_number() OVER (PARTITION BY ids.query ORDER BY 1 - list_cosine_similarity(ids.v, e.v), e.vec_id) AS rank
        FROM ids JOIN e ON e.vec_id <> ids.query QUALIFY rank <= 5),
    points AS (SELECT query, query AS p FROM ids UNION ALL SELECT query, p FROM near),
    far AS (SELECT a.query, a.p, b.p AS o, list_distance(x.v, y.v) AS d FROM points a JOIN points b ON a.query = b.query AND a.p <> b.p JOIN e x ON x.vec_id = a.p JOIN e y ON y.vec_id = b.p),
    kd AS (SELECT query, p, max(d) AS kd FROM far GROUP BY ALL),
    dense AS (SELECT f.query, f.p, 1 / greatest(avg(greatest(f.d, k.kd)), 1e-12) AS density FROM far f JOIN kd k ON k.query = f.query AND k.p = f.o GROUP BY ALL),
    lof AS (SELECT f.query, avg(l.density) / any_value(own.density) AS lof FROM far f JOIN dense l ON l.query = f.query AND l.p = f.o JOIN dense own ON own.query = f.query AND own.p = f.p WHERE f.p = f.query GROUP BY 1),
    facts AS (SELECT query, lof, max(distance) AS last, avg(distance) AS mean FROM near JOIN lof USING (query) GROUP BY ALL),
    parts AS (SELECT *, least(1e0, 0.6e0 * last + 0.4e0 * mean) AS d, CASE WHEN lof > 1 THEN least((lof - 1) / 2, 1e0) ELSE 0e0 END AS f FROM facts)
    SELECT query, round(lof, 6) AS lof, round(last, 6) AS last, round(mean, 6) AS mean, round(greatest(0e0, least(1e0, 0.6e0 * sqrt((d * d + f * f + least(1.2e0 * d, 1e0) ** 2 + 0.64e0 * d * d + 0.81e0 * f * f) / 5)
      + 0.4e0 * (0.3e0 * d + 0.25e0 * f + 0.2e0 * least(1.2e0 * d, 1e0) + 0.15e0 * 0.8e0 * d + 0.1e0 * 0.9e0 * f))), 6) AS novelty FROM parts
    """,
)
def local_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlier factor of each query vector among itself and its five nearest, with the novelty that follows."""
    rows = _e(spark, sf_dir)
    near = similarity.nearest(rows, rows.filter(_QUERY), "vec_id", "embedding", 5)
    vectors = near.join(rows, "vec_id").select("query", "rank", "distance", V.doubles(F.col("embedding")).alias("v"))
    own = rows.filter(_QUERY).select(F.col("vec_id").alias("query"), F.lit(0).alias("rank"), F.lit(0.0).alias("distance"), V.doubles(F.col("embedding")).alias("v"))

    def factor(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        lof = similarity.local_outlier_factor(np.stack(frame["v"]), 5)[0] if len(frame) >= 4 else np.inf
        d = frame["distance"].to_numpy()[1:]
        return pd.DataFrame({"query": [frame["query"].iloc[0]], "lof": [float(lof)], "last": [float(d.max(initial=0))], "mean": [float(d.mean()) if len(d) else 0.0]})

    out = own.unionByName(vectors).groupBy("query").applyInPandas(factor, "query long, lof double, last double, mean double")
    out = out.withColumn("novelty", S.novelty(S.distance_novelty(F.col("last"), F.col("mean")), F.col("lof")))
    return out.withColumns({c: F.round(c, 6) for c in ("lof", "last", "mean", "novelty")})


@register("graph_embeddings")
def graph_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vector and embedding of each host-and-day graph."""
    t = telemetry(spark, sf_dir).withColumn("graph_id", F.concat_ws(":", "host", F.to_date("ts")))
    g = graphs.embed_graphs(t, "graph_id", "event_id", "event_type", "ts", "pid")
    return g.select("graph", "n_nodes", F.round(F.get("features", 0), 6).alias("first_feature"), F.round(V.norm(F.col("embedding")), 6).alias("norm"))


_TACTIC = "CASE event_type WHEN 'authentication' THEN 'initial_access' WHEN 'powershell' THEN 'privilege_escalation' WHEN 'process' THEN 'persistence' WHEN 'file' THEN 'discovery' ELSE 'exfiltration' END"
_GRAPH = f"""
    t AS (SELECT concat(host, ':', CAST(ts AS DATE)) AS g, event_id, ts, pid, {_TACTIC} AS action FROM telemetry),
    w AS (SELECT g, event_id AS src, lead(event_id) OVER (PARTITION BY g ORDER BY ts, event_id) AS dst FROM t UNION SELECT g, event_id, lead(event_id) OVER (PARTITION BY g, pid ORDER BY ts, event_id) FROM t),
    d AS (SELECT DISTINCT g, src, dst FROM w WHERE dst IS NOT NULL), k AS (SELECT g, node, count(*) AS degree FROM (SELECT g, src AS node FROM d UNION ALL SELECT g, dst FROM d) GROUP BY ALL)
"""


def _host_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = telemetry(spark, sf_dir).select(F.concat_ws(":", "host", F.to_date("ts")).alias("g"), "event_id", "ts", "pid", F.expr(_TACTIC).alias("action"))
    return graphs.behaviour_graph(t, "g", "event_id", "action", "ts", "pid")


@register(
    "graph_profiles",
    f"""
    WITH {TELEMETRY}, {_GRAPH}, n AS (SELECT g, count(*) AS node_count FROM t GROUP BY g), m AS (SELECT g, count(*) AS edge_count FROM d GROUP BY g),
    x AS (SELECT d1.g, d1.src AS a, d1.dst AS b, d2.dst AS c FROM d d1 JOIN d d2 ON d1.g = d2.g AND d1.dst = d2.src JOIN d d3 ON d3.g = d1.g AND d3.src = d1.src AND d3.dst = d2.dst),
    tr AS (SELECT g, count(*) AS triangles FROM x GROUP BY g),
    ed AS (SELECT g, a, b, count(*) AS c FROM (SELECT g, a, b FROM x UNION ALL SELECT g, a, c FROM x UNION ALL SELECT g, b, c FROM x) GROUP BY ALL), sq AS (SELECT g, sum(c * (c - 1) / 2) AS squares FROM ed GROUP BY g),
    tn AS (SELECT g, node, count(*) AS t FROM (SELECT g, a AS node FROM x UNION ALL SELECT g, b FROM x UNION ALL SELECT g, c FROM x) GROUP BY ALL), cl AS (SELECT g, sum(2 * t / (degree * (degree - 1))) AS total FROM tn JOIN k USING (g, node) GROUP BY g),
    es AS (SELECT d.g, count(*) * 2.0e0 AS escalation FROM d JOIN t p ON p.g = d.g AND p.event_id = d.src JOIN t q ON q.g = d.g AND q.event_id = d.dst
      WHERE (p.action, q.action) IN (('initial_access', 'privilege_escalation'), ('privilege_escalation', 'persistence'), ('persistence', 'discovery')) GROUP BY 1),
    dg AS (SELECT g, max(degree) AS degree_max FROM k GROUP BY g)
    SELECT n.g, CAST(node_count AS DOUBLE) AS node_count, coalesce(edge_count, 0.0e0) AS edge_count, round(coalesce(edge_count / (node_count * (node_count - 1)), 0), 9) AS density, coalesce(degree_max, 0.0e0) AS degree_max,
      coalesce(triangles, 0.0e0) AS triangles, coalesce(squares, 0.0e0) AS squares, round(coalesce(total, 0) / node_count, 9) AS clustering, coalesce(escalation, 0.0e0) AS escalation
    FROM n LEFT JOIN m USING (g) LEFT JOIN tr USING (g) LEFT JOIN sq USING (g) LEFT JOIN cl USING (g) LEFT JOIN es USING (g) LEFT JOIN dg USING (g)
    """,
)
def graph_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each host-and-day graph, all events counted."""
    f = graphs.graph_features(*_host_graph(spark, sf_dir), "g")
    return f.select("g", "node_count", "edge_count", F.round("density", 9).alias("density"), "degree_max", "triangles", "squares", F.round("clustering", 9).alias("clustering"), "escalation")


@register(
    "pruned_graphs",
    f"""
    WITH {TELEMETRY}, {_GRAPH}, i AS (SELECT t.g, t.event_id AS node, coalesce(degree, 0) + CASE WHEN action IN ('privilege_escalation', 'persistence', 'exfiltration', 'impact') THEN 10.0e0 ELSE 0 END
      + CASE WHEN pid % 13 = 0 THEN 5.0e0 ELSE 0 END AS importance FROM t LEFT JOIN k ON k.g = t.g AND k.node = t.event_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY importance DESC, node) AS rank FROM i), p AS (SELECT * FROM r WHERE rank <= 8)
    SELECT g, count(*) AS nodes, sum(importance) AS importance, min(node) AS first, (SELECT count(*) FROM d JOIN p a ON a.g = d.g AND a.node = d.src JOIN p b ON b.g = d.g AND b.node = d.dst WHERE d.g = p.g) AS edges FROM p GROUP BY g
    """,
)
def pruned_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graphs.prune(*_host_graph(spark, sf_dir), "g", 8, F.col("actor") % 13 == 0)
    kept = nodes.groupBy("g").agg(F.count("*").alias("nodes"), F.sum("importance").alias("importance"), F.min("node").alias("first"))
    return kept.join(edges.groupBy("g").agg(F.count("*").alias("edges")), "g", "left").fillna(0, ["edges"])


_EDGES = """
    e AS (SELECT user_id % 20 AS g, event_type || ':' || (event_id % 9) AS node, ts, event_id FROM events),
    c AS (SELECT g, node AS src, lead(node) OVER (PARTITION BY g ORDER BY ts, event_id) AS dst FROM e), d AS (SELECT DISTINCT g, src, dst FROM c WHERE dst IS NOT NULL)
"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select((F.col("user_id") % 20).alias("g"), F.concat_ws(":", "event_type", F.col("event_id") % 9).alias("node"), "ts", "event_id")
    return windows.consecutive(rows, ["g"], ["ts", "event_id"], "node", "ts").select("g", "src", "dst").distinct()


@register(
    "graph_degrees",
    f"""
    WITH {_EDGES}, o AS (SELECT g, src AS node, count(*) AS n FROM d GROUP BY ALL), i AS (SELECT g, dst AS node, count(*) AS n FROM d GROUP BY ALL)
    SELECT coalesce(o.g, i.g) AS g, coalesce(o.node, i.node) AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree
    FROM o FULL JOIN i ON o.g = i.g AND o.node = i.node
    """,
)
def graph_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.degrees(_edges(spark, sf_dir), "g")


@register(
    "graph_triangles",
    f"""
    WITH {_EDGES}, u AS (SELECT DISTINCT g, least(src, dst) AS a, greatest(src, dst) AS b FROM d WHERE src <> dst)
    SELECT x.g, count(*) AS triangles FROM u x JOIN u y ON x.g = y.g AND x.b = y.a JOIN u z ON z.g = x.g AND z.a = x.a AND z.b = y.b GROUP BY x.g
    """,
)
def graph_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.triangles(_edges(spark, sf_dir), "g")


@register(
    "graph_density",
    f"WITH {_EDGES}, n AS (SELECT g, count(DISTINCT node) AS n FROM e GROUP BY g), m AS (SELECT g, count(*) AS m FROM d GROUP BY g) SELECT n.g, n, m, round(m / (n * (n - 1e0)), 9) AS density FROM n JOIN m ON n.g = m.g",
)
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _edges(spark, sf_dir)
    nodes = d.select("g", F.col("src").alias("node")).union(d.select("g", "dst")).groupBy("g").agg(F.countDistinct("node").alias("n"))
    m = d.groupBy("g").agg(F.count("*").alias("m"))
    return nodes.join(m, "g").withColumn("density", F.round(F.col("m") / (F.col("n") * (F.col("n") - 1)), 9))
