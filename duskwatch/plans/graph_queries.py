"""Queries of path measures and centralities over behaviour graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import centrality, graphs, paths

from .registry import register
from .telemetry import TELEMETRY
from .vector_queries import _GRAPH, _host_graph

_STEPS = 12
_PATHS = f"""
    WITH RECURSIVE {TELEMETRY}, {_GRAPH}, sz AS (SELECT g, count(*) AS n FROM t GROUP BY g),
    walks AS (SELECT g, event_id AS s, event_id AS v, 0 AS d, 1e0 AS ways FROM t
              UNION ALL SELECT w.g, w.s, d.dst, w.d + 1, sum(w.ways) FROM walks w JOIN d ON d.g = w.g AND d.src = w.v GROUP BY w.g, w.s, d.dst, w.d),
    sp AS (SELECT g, s, v, min(d) AS d, arg_min(ways, d) AS ways FROM walks GROUP BY ALL),
    bt AS (SELECT a.g, a.v AS node, sum(a.ways * b.ways / c.ways) AS total FROM sp a JOIN sp b ON a.g = b.g AND a.v = b.s AND a.d > 0 AND b.d > 0 JOIN sp c ON c.g = a.g AND c.s = a.s AND c.v = b.v AND c.d = a.d + b.d GROUP BY ALL),
    cl AS (SELECT g, v AS node, count(*) FILTER (d > 0) AS r, sum(d) AS far FROM sp GROUP BY ALL),
    pn AS (SELECT t.g, n, t.event_id, CASE WHEN n > 2 THEN coalesce(total, 0) / ((n - 1) * (n - 2)) ELSE coalesce(total, 0) END AS between_, CASE WHEN far > 0 THEN r * r / (far * (n - 1e0)) ELSE 0 END AS close_
           FROM t JOIN sz USING (g) LEFT JOIN bt ON bt.g = t.g AND bt.node = t.event_id LEFT JOIN cl ON cl.g = t.g AND cl.node = t.event_id),
    pg AS (SELECT g, max(between_) AS bm, avg(between_) AS ba, max(close_) AS cm, avg(close_) AS ca FROM pn GROUP BY g),
    cr AS (SELECT sp.g, max(sp.d) AS critical FROM sp WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.g = sp.g AND d.dst = sp.s) GROUP BY sp.g),
    ex AS (SELECT sp.g, count(*) AS chains FROM sp JOIN t a ON a.g = sp.g AND a.event_id = sp.s JOIN t b ON b.g = sp.g AND b.event_id = sp.v
           WHERE sp.d > 0 AND a.action IN ('execution', 'persistence', 'privilege_escalation') AND b.action IN ('execution', 'persistence', 'privilege_escalation') GROUP BY sp.g)
    SELECT g, critical::DOUBLE AS critical_path, coalesce(chains, 0)::DOUBLE AS execution_chains, round(bm, 9) AS betweenness_max, round(ba, 9) AS betweenness_avg, round(cm, 9) AS closeness_max, round(ca, 9) AS closeness_avg
    FROM pg LEFT JOIN cr USING (g) LEFT JOIN ex USING (g)
"""


@register("path_measures", _PATHS)
def path_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed path measures of each host-and-day graph."""
    found = paths.path_measures(*_pruned(spark, sf_dir), "g")
    return found.select("g", "critical_path", "execution_chains", *[F.round(c, 9).alias(c) for c in ("betweenness_max", "betweenness_avg", "closeness_max", "closeness_avg")])


def _pruned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graphs.prune(*_host_graph(spark, sf_dir), "g")


def _by_actor(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The host-and-day graphs with the edges of actors alone."""
    nodes, edges = _host_graph(spark, sf_dir)
    return nodes, edges.filter("kind = 'causal'")


_CAUSAL = f"""
    {_GRAPH}, c AS (SELECT * FROM (SELECT g, event_id AS src, lead(event_id) OVER (PARTITION BY g, pid ORDER BY ts, event_id) AS dst FROM t) WHERE dst IS NOT NULL),
    u AS (SELECT g, src AS a, dst AS b FROM c UNION SELECT g, dst, src FROM c)
"""
_NEAR = f"""
    WITH RECURSIVE {TELEMETRY}, {_CAUSAL}, sz AS (SELECT g, count(*) AS n FROM t GROUP BY g),
    r AS (SELECT g, event_id AS s, event_id AS v, 0 AS d FROM t UNION SELECT r.g, r.s, u.b, r.d + 1 FROM r JOIN sz USING (g) JOIN u ON u.g = r.g AND u.a = r.v WHERE r.d + 1 < n AND r.d < 12),
    sp AS (SELECT g, s, v, min(d) AS d FROM r GROUP BY ALL)
"""


@register("weak_components", f"{_NEAR} SELECT g, s AS node, min(v) AS component FROM sp GROUP BY ALL")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graphs of actors, by labels that travel along edges."""
    return centrality.components(*_by_actor(spark, sf_dir), "g")


@register(
    "component_measures",
    f"""
    {_NEAR}, kk AS (SELECT g, s, min(v) AS component, max(d) AS far FROM sp GROUP BY ALL), z AS (SELECT g, component, count(*) AS size FROM kk GROUP BY ALL)
    SELECT kk.g, count(DISTINCT kk.component)::DOUBLE AS components, max(size)::DOUBLE AS largest_component, CASE WHEN count(DISTINCT kk.component) = 1 THEN max(far) ELSE 0 END::DOUBLE AS diameter,
      CASE WHEN count(DISTINCT kk.component) = 1 THEN min(far) ELSE 0 END::DOUBLE AS radius FROM kk JOIN z ON z.g = kk.g AND z.component = kk.component GROUP BY kk.g
    """,
)
def component_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components, diameter and radius of the graphs of actors; both are 0 unless a graph hangs together."""
    return paths.component_measures(*_by_actor(spark, sf_dir), "g")


def _unrolled(step: str, first: str, steps: int) -> str:
    return ", ".join([f"x0 AS MATERIALIZED ({first})", *[f"x{i} AS MATERIALIZED ({step.replace('$', f'x{i - 1}')})" for i in range(1, steps + 1)]])


_RANKED = _unrolled(
    """SELECT p.g, p.node, p.n, p.out, 0.85e0 * (coalesce(got, 0) + loose / n) + 0.15e0 / n AS x FROM $ p LEFT JOIN (SELECT d.g, d.dst AS node, sum(q.x / q.out) AS got FROM $ q JOIN d ON d.g = q.g AND d.src = q.node GROUP BY ALL) m ON m.g = p.g AND m.node = p.node
       JOIN (SELECT g, sum(CASE WHEN out = 0 THEN x ELSE 0e0 END) AS loose FROM $ GROUP BY g) l ON l.g = p.g""",
    "SELECT t.g, t.event_id AS node, n, coalesce(o.out, 0) AS out, 1e0 / n AS x FROM t JOIN (SELECT g, count(*) AS n FROM t GROUP BY g) s USING (g) LEFT JOIN (SELECT g, src, count(*) AS out FROM d GROUP BY ALL) o ON o.g = t.g AND o.src = t.event_id",
    _STEPS,
)
_INFLUENCE = _unrolled(
    """SELECT g, node, y / sqrt(sum(y * y) OVER (PARTITION BY g)) AS x FROM (SELECT p.g, p.node, p.x + coalesce(got, 0) AS y FROM $ p LEFT JOIN (SELECT d.g, d.dst AS node, sum(q.x) AS got FROM $ q JOIN d ON d.g = q.g AND d.src = q.node GROUP BY ALL) m ON m.g = p.g AND m.node = p.node)""",
    "SELECT t.g, t.event_id AS node, 1e0 / n AS x FROM t JOIN (SELECT g, count(*) AS n FROM t GROUP BY g) s USING (g)",
    _STEPS,
)


@register("pagerank", f"WITH {TELEMETRY}, {_GRAPH}, {_RANKED} SELECT g, node, round(x, 9) AS rank FROM x{_STEPS}")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centrality.pagerank(*_host_graph(spark, sf_dir), "g", steps=_STEPS, tolerance=0.0)
    return found.select("g", "node", F.round("rank", 9).alias("rank"))


@register("eigenvector_centrality", f"WITH {TELEMETRY}, {_GRAPH}, {_INFLUENCE} SELECT g, node, round(x, 9) AS influence FROM x{_STEPS}")
def eigenvector_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centrality.eigenvector(*_host_graph(spark, sf_dir), "g", steps=_STEPS, tolerance=0.0)
    return found.select("g", "node", F.round("influence", 9).alias("influence"))
