"""Queries for the remaining joins, graphs, settings and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.functions import text
from duskwatch.operators import forensics, intel, matching, sinks
from duskwatch.operators.windows import first_n

from .registry import register
from .telemetry import TELEMETRY, telemetry


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_INTENTS = {"authentication": "T1110", "powershell": "T1059.001", "network": "T1071", "file": "T1105"}


@register(
    "intent_techniques",
    f"""
    WITH {TELEMETRY}, k(event_type, technique) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _INTENTS.items())})
    SELECT t.event_type, coalesce(k.technique, 'UNMAPPED') AS technique, count(*) AS n FROM telemetry t LEFT JOIN k ON t.event_type = k.event_type GROUP BY ALL
    """,
)
def intent_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame(list(_INTENTS.items()), "event_type string, technique string")
    counts = telemetry(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.join(known, "event_type", "left").select("event_type", F.coalesce("technique", F.lit("UNMAPPED")).alias("technique"), "n")


@register(
    "exact_or_vendor_match",
    """
    WITH q AS (SELECT p_partkey, p_brand, p_name FROM part WHERE p_partkey % 50 = 0), e AS (SELECT q.p_partkey, s_suppkey, 0 AS p FROM q JOIN supplier ON q.p_partkey = s_suppkey),
    v AS (SELECT q.p_partkey, s_suppkey, 1 AS p FROM q JOIN supplier ON s_suppkey % 50 = q.p_partkey % 49),
    u AS (SELECT p_partkey, s_suppkey, min(p) AS p FROM (SELECT * FROM e UNION ALL SELECT * FROM v) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY p, s_suppkey) AS rn FROM u)
    SELECT p_partkey, s_suppkey, CASE p WHEN 0 THEN 'exact' ELSE 'vendor' END AS kind FROM r WHERE rn <= 3
    """,
)
def exact_or_vendor_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact key first, then a looser key, three hits at most; of each looser key only as many suppliers meet as can be hits."""
    q = _t(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select("p_partkey").distinct()
    s = _t(spark, sf_dir, "supplier").select("s_suppkey").distinct()
    exact = q.join(s, F.col("p_partkey") == F.col("s_suppkey")).withColumn("p", F.lit(0))
    few = first_n(s.withColumn("k", F.col("s_suppkey") % 50), ["k"], [F.col("s_suppkey")], 4)  # one may be the exact hit
    vendor = q.withColumn("k", F.col("p_partkey") % 49).join(few, "k").drop("k").withColumn("p", F.lit(1))
    best = exact.unionByName(vendor).groupBy("p_partkey", "s_suppkey").agg(F.min("p").alias("p"))
    return first_n(best, ["p_partkey"], [F.col("p"), F.col("s_suppkey")], 3).select("p_partkey", "s_suppkey", F.when(F.col("p") == 0, "exact").otherwise("vendor").alias("kind"))


@register(
    "similar_patterns",
    """
    WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part), q AS (SELECT * FROM p),
    s AS (SELECT q.p_partkey, p.p_partkey AS other, 100e0 * len(list_intersect(q.w, p.w)) / len(list_distinct(list_concat(q.w, p.w))) AS score FROM q JOIN p ON q.p_partkey <> p.p_partkey AND list_has_any(q.w, p.w)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS rn FROM s WHERE score > 30)
    SELECT p_partkey, other, round(score, 6) AS score FROM r WHERE rn <= 5
    """,
)
def similar_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most similar of every part by shared words; candidates come from an inverted list of the different sets of words."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("w"))
    found = matching.most_alike(rows, rows, "p_partkey", "w", 30, 5)
    return found.select("p_partkey", "other", F.round("score", 6).alias("score"))


@register(
    "relationship_graph",
    """
    WITH e AS (SELECT c_custkey AS root, 'orders' AS kind, CAST(o_orderkey AS VARCHAR) AS target FROM customer JOIN orders ON c_custkey = o_custkey
      UNION ALL SELECT c_custkey, 'nation', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer)
    SELECT root, kind, target FROM e
    """,
)
def relationship_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    o = c.join(_t(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("root"), F.lit("orders").alias("kind"), F.col("o_orderkey").cast("string").alias("target"))
    n = c.join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("root"), F.lit("nation").alias("kind"), F.col("n_name").alias("target"))
    s = c.select(F.col("c_custkey").alias("root"), F.lit("segment").alias("kind"), F.col("c_mktsegment").alias("target"))
    return o.unionByName(n).unionByName(s)


@register(
    "critical_path",
    f"""
    WITH {TELEMETRY}, h AS (SELECT host, event_id, ts, severity, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY host) AS n FROM telemetry WHERE severity IN ('CRITICAL', 'HIGH'))
    SELECT host, event_id, CAST(rn AS INT) AS step FROM h WHERE n >= 3 AND rn <= 10
    """,
)
def critical_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).filter("severity in ('CRITICAL', 'HIGH')").select("host", "event_id", "ts")
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    top = rows.withColumn("step", F.row_number().over(w)).filter("step <= 10")
    enough = rows.groupBy("host").agg(F.count("*").alias("n")).filter("n >= 3")
    return top.join(enough, "host").select("host", "event_id", "step")


@register(
    "process_descendants",
    """
    WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey // 3 AS parent FROM customer WHERE c_custkey > 0),
    d AS (SELECT node, parent AS ancestor, 1 AS depth FROM t WHERE parent > 0 UNION ALL SELECT d.node, t.parent, d.depth + 1 FROM d JOIN t ON t.node = d.ancestor WHERE t.parent > 0)
    SELECT ancestor, count(*) AS descendants, CAST(max(depth) AS INT) AS depth FROM d GROUP BY ancestor
    """,
)
def process_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each node of a tree by counts that go up a level at a time."""
    t = _t(spark, sf_dir, "customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 3").alias("parent"))
    return forensics.descendants(t.filter("parent > 0"))


@register(
    "setting_checks",
    """
    WITH s AS (SELECT CASE event_id % 3 WHEN 0 THEN 'query_timeout_ms' WHEN 1 THEN 'similarity_threshold' ELSE 'enabled' END AS key, CASE event_id % 4 WHEN 0 THEN '50' WHEN 1 THEN '0.5' WHEN 2 THEN 'yes' ELSE '-1' END AS value FROM events)
    SELECT key, value, CASE key WHEN 'query_timeout_ms' THEN CASE WHEN value NOT IN ('50', '-1') THEN 'not a int' WHEN value = '-1' THEN 'out of range' END
      WHEN 'similarity_threshold' THEN CASE WHEN value = 'yes' THEN 'not a float' WHEN value IN ('50', '-1') THEN 'out of range' END
      ELSE CASE WHEN value <> 'yes' THEN 'not a boolean' END END AS error, count(*) AS n FROM s GROUP BY ALL
    """,
)
def setting_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("CASE event_id % 3 WHEN 0 THEN 'query_timeout_ms' WHEN 1 THEN 'similarity_threshold' ELSE 'enabled' END")
    value = F.expr("CASE event_id % 4 WHEN 0 THEN '50' WHEN 1 THEN '0.5' WHEN 2 THEN 'yes' ELSE '-1' END")
    rows = _t(spark, sf_dir, "events").select(key.alias("key"), value.alias("value"))
    return rows.withColumn("error", sinks.setting_error(F.col("key"), F.col("value"))).groupBy("key", "value", "error").agg(F.count("*").alias("n"))


@register(
    "rule_texts",
    """
    SELECT p_partkey, concat('title: ', p_name, chr(10), 'logsource:', chr(10), '  category: process_creation', chr(10), 'detection:', chr(10), '  selection:', chr(10), '    CommandLine|contains: ', chr(39), p_brand, chr(39), chr(10),
        '  condition: selection', chr(10), 'level: high', chr(10)) AS sigma,
      concat('rule ', regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g'), ' {', chr(10), '  strings:', chr(10), array_to_string(list_transform(string_split(p_name, ' '), lambda s, i: concat('    $s', i - 1, ' = "', s, '"')), chr(10)), chr(10),
        '  condition:', chr(10), '    any of them', chr(10), '}', chr(10)) AS yara
    FROM part
    """,
)
def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", sinks.sigma_rule(F.col("p_name"), F.col("p_brand"), F.lit("high")).alias("sigma"), sinks.yara_rule(F.col("p_name"), F.split("p_name", " ")).alias("yara"))


@register("event_summaries", f"WITH {TELEMETRY} SELECT event_id, concat('type=', event_type, ', pid=', pid, ', src=', src_ip) AS summary FROM telemetry")
def event_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"type": F.col("event_type"), "none": F.lit(None).cast("string"), "pid": F.col("pid"), "src": F.col("src_ip"), "dst": F.col("dst_ip")}
    return telemetry(spark, sf_dir).select("event_id", text.summary(fields).alias("summary"))


@register("cve_lookup", "SELECT o_orderkey, coalesce(n_name, 'none') AS vendor FROM orders LEFT JOIN nation ON o_custkey % 40 = n_nationkey")
def cve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intel.lookup(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf_dir, "nation"), F.col("o_custkey") % 40, F.col("n_nationkey"), {"n_name": "vendor"})
    return rows.select("o_orderkey", F.coalesce("vendor", F.lit("none")).alias("vendor"))


@register("registry_statistics", "SELECT p_type, p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())")
def registry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").groupingSets([[F.col("p_type")], [F.col("p_brand")], []], F.col("p_type"), F.col("p_brand")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
