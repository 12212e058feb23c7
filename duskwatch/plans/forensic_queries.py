"""Queries of forensic chains, timelines, latencies, relationships and ancestry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import forensics

from .registry import register
from .telemetry import TELEMETRY, telemetry


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Customers are campaigns of their even orders, first lines of every third order are actions, suppliers are patterns.
_FORENSIC = """
    ev AS (SELECT 'E' || event_id AS id, 'C' || (user_id % 500) AS corr, ts FROM events),
    cl AS (SELECT 'K' || o_custkey AS cid, 'E' || o_orderkey AS eid FROM orders WHERE o_orderkey % 2 = 0),
    al AS (SELECT 'A' || l_orderkey AS aid, unnest(['E' || l_orderkey, 'E' || (l_orderkey + 1)]) AS eid FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 = 0),
    pk AS (SELECT 'P' || s_suppkey AS pid, unnest(['P' || s_suppkey, 'E' || (s_suppkey * 3), 'C' || s_suppkey, 'K' || s_suppkey]) AS k FROM supplier),
    roots AS (SELECT id AS root FROM ev UNION SELECT corr FROM ev UNION SELECT cid FROM cl UNION SELECT aid FROM al UNION SELECT 'X' || n_nationkey FROM nation),
    direct AS (SELECT root, id, ts FROM roots JOIN ev ON root = id UNION SELECT root, id, ts FROM roots JOIN ev ON root = corr),
    own AS (SELECT root, min(cid) AS cid FROM (SELECT root, cid FROM roots JOIN cl ON root = cid UNION SELECT root, cid FROM roots JOIN cl ON root = eid) GROUP BY root),
    taken AS (SELECT root, aid FROM roots JOIN al ON root = aid UNION SELECT root, aid FROM roots JOIN al ON root = eid),
    ref AS (SELECT root, eid FROM own JOIN cl USING (cid) UNION SELECT root, eid FROM taken JOIN al USING (aid)),
    seen AS (SELECT * FROM direct UNION SELECT root, id, ts FROM ref JOIN ev ON id = eid WHERE root NOT IN (SELECT root FROM direct)),
    camp AS (SELECT root, cid FROM own UNION ALL SELECT root, cid FROM seen JOIN cl ON eid = id WHERE root NOT IN (SELECT root FROM own)
        QUALIFY row_number() OVER (PARTITION BY root ORDER BY ts NULLS FIRST, id, cid) = 1),
    act AS (SELECT root, aid FROM taken UNION ALL SELECT DISTINCT root, aid FROM seen JOIN al ON eid = id WHERE root NOT IN (SELECT root FROM taken)),
    pat AS (SELECT root, min(pid) AS pid FROM roots JOIN pk ON k = root GROUP BY root),
    n AS (SELECT root, (SELECT count(*) FROM seen s WHERE s.root = r.root) AS n_events, (SELECT count(*) FROM pat s WHERE s.root = r.root) AS n_patterns,
        (SELECT count(*) FROM camp s WHERE s.root = r.root) AS n_campaigns, (SELECT count(*) FROM act s WHERE s.root = r.root) AS n_actions FROM roots r)
"""


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = lambda letter, c: F.concat(F.lit(letter), c if isinstance(c, Column) else F.col(c))
    events = _t(spark, sf_dir, "events").select(name("E", "event_id").alias("event_id"), name("C", F.col("user_id") % 500).alias("correlation_id"), "ts")
    held = _t(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").groupBy(name("K", "o_custkey").alias("campaign_id")).agg(F.collect_list(name("E", "o_orderkey")).alias("evidence_event_ids"))
    k = F.col("l_orderkey")
    actions = _t(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_orderkey % 3 = 0").select(name("A", k).alias("audit_id"), F.array(name("E", k), name("E", k + 1)).alias("evidence_event_ids"))
    s = F.col("s_suppkey")
    patterns = _t(spark, sf_dir, "supplier").select(
        name("P", s).alias("pattern_id"), name("E", s * 3).alias("fingerprint"), name("C", s).alias("related_investigation_id"), name("K", s).alias("related_threat_id")
    )
    roots = events.select(F.col("event_id").alias("root"))
    for other in (events.select("correlation_id"), held.select("campaign_id"), actions.select("audit_id"), _t(spark, sf_dir, "nation").select(name("X", "n_nationkey"))):
        roots = roots.union(other)
    return forensics.evidence_chains(roots, events, patterns, held, actions)


@register(
    "forensic_chains",
    f"""
    WITH {_FORENSIC} SELECT *, CASE WHEN n_events > 0 THEN 1 ELSE 0 END + n_patterns + n_campaigns + n_actions AS stages_completed,
      CASE WHEN n_events + n_patterns + n_campaigns + n_actions = 0 THEN 'INSUFFICIENT_DATA' WHEN n_events > 0 AND n_campaigns > 0 AND n_actions > 0 THEN 'PROVEN_CHAIN' ELSE 'PARTIAL_CHAIN' END AS status FROM n
    """,
)
def forensic_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the chain of every id reaches."""
    return _chains(spark, sf_dir)[0]


@register(
    "forensic_stages",
    f"""
    WITH {_FORENSIC} SELECT root, 'TELEMETRY_INGESTION' AS stage, id AS record FROM seen UNION ALL SELECT root, 'BEHAVIORAL_DNA_ANALYSIS', pid FROM pat UNION ALL SELECT root, 'CAMPAIGN_ATTRIBUTION', cid FROM camp
    UNION ALL SELECT root, 'DEFENSIVE_ACTION', aid FROM act
    """,
)
def forensic_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every chain."""
    return _chains(spark, sf_dir)[1]


@register(
    "listed_timeline",
    """
    WITH c AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice, o_orderkey) AS ids FROM orders GROUP BY 1), p AS (SELECT o_custkey, unnest(ids) AS id, unnest(range(len(ids))) AS position FROM c)
    SELECT o_custkey, position::INTEGER AS position, event_id, event_type, ts FROM p JOIN events ON event_id = id
    """,
)
def listed_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as campaigns that list events by order, cheapest first."""
    sorted_ids = F.transform(F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))), lambda r: r["o_orderkey"])
    lists = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(sorted_ids.alias("ids"))
    return forensics.timeline(lists, _t(spark, sf_dir, "events").select("event_id", "event_type", "ts"), "o_custkey", "ids", "event_id")


_ACTIONS = """
    a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'VERIFIED' ELSE 'COMPLETED' END AS status, ts, event_id - 1 - event_id % 3 AS first, CASE WHEN event_id % 5 > 0 THEN (event_id % 5 - 1) * 1.5e0 END AS dur FROM events),
    g AS (SELECT a.*, (epoch_us(a.ts) - epoch_us(e.ts)) / 1e6 AS gap FROM a LEFT JOIN events e ON e.event_id = a.first WHERE status <> 'FAILED'),
    l AS (SELECT event_id, round(coalesce(CASE WHEN gap > 0 AND gap <= 86400 THEN gap END, CASE WHEN dur > 0 THEN dur END), 2) AS latency FROM g)
"""


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = _t(spark, sf_dir, "events").select("event_id", "ts"), F.col("event_id")
    actions = e.select(
        "event_id", "ts", F.when(i % 4 == 0, "FAILED").when(i % 4 == 1, "VERIFIED").otherwise("COMPLETED").alias("execution_status"), F.array(i - 1 - i % 3, i).alias("evidence_event_ids"),
        F.when(i % 5 > 0, (i % 5 - 1) * 1.5).alias("duration_seconds"),
    )
    return forensics.response_latencies(actions, e).select("event_id", "latency")


@register("response_latencies", f"WITH {_ACTIONS} SELECT event_id, latency FROM l WHERE latency IS NOT NULL")
def response_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions on an earlier event."""
    return _responses(spark, sf_dir)


@register(
    "latency_summary",
    f"""
    WITH {_ACTIONS}, s AS (SELECT list_sort(list(latency)) AS v, count(latency) AS sample_size, round(avg(latency), 2) AS mean FROM l WHERE latency IS NOT NULL)
    SELECT sample_size, mean, v[sample_size // 2 + 1] AS p50, v[sample_size * 9 // 10 + 1] AS p90, v[sample_size * 19 // 20 + 1] AS p95, 'CALCULATED' AS status FROM s
    """,
)
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and places of all response latencies."""
    return forensics.latency_statistics(_responses(spark, sf_dir))


@register(
    "detection_latencies",
    """
    WITH c AS (SELECT user_id, min(ts) AS a, CASE WHEN user_id % 3 = 0 THEN min(ts) + INTERVAL 90 SECOND ELSE max(ts) END AS b FROM events GROUP BY 1)
    SELECT user_id, (epoch_us(b) - epoch_us(a)) / 1e6 AS latency FROM c WHERE epoch_us(b) - epoch_us(a) BETWEEN 0 AND 86400000000
    """,
)
def detection_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as campaigns, every third with a time of creation."""
    c = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    c = c.withColumn("created_at", F.when(F.col("user_id") % 3 == 0, F.col("first_seen") + F.expr("INTERVAL 90 SECOND")))
    return forensics.detection_latencies(c).select("user_id", "latency")


_STAR = f"""
    {TELEMETRY}, c AS (SELECT 'CMP-' || user_id AS id, src_ip, nullif(dst_ip, '') AS dst_ip, host, CASE WHEN severity = 'HIGH' THEN 'T1059' END AS technique FROM telemetry),
    e AS (SELECT DISTINCT id AS source, 'ip-' || src_ip AS target, 'OBSERVED_IN' AS label, 'ip' AS kind FROM c UNION SELECT id, 'dst-' || dst_ip, 'CONNECTED_TO', 'ip' FROM c WHERE dst_ip IS NOT NULL
        UNION SELECT id, 'host-' || host, 'TARGETED', 'host' FROM c UNION SELECT id, 'tech-' || technique, 'EXECUTED', 'technique' FROM c WHERE technique IS NOT NULL)
"""


@register(
    "campaign_relationships",
    f"WITH {_STAR} SELECT source, target, label, kind FROM e UNION ALL SELECT DISTINCT id, id, NULL, 'campaign' FROM c",
)
def campaign_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as campaigns with the addresses, hosts and techniques of their events: edges with the kind of their end, and centres."""
    some = lambda c: F.collect_set(c)
    campaigns = telemetry(spark, sf_dir).groupBy(F.concat(F.lit("CMP-"), "user_id").alias("campaign_id")).agg(
        some("src_ip").alias("source_ips"), some(F.nullif(F.col("dst_ip"), F.lit(""))).alias("destination_ips"), some("host").alias("hosts"), some(F.when(F.col("severity") == "HIGH", "T1059")).alias("technique_ids")
    )
    nodes, edges = forensics.relationships(campaigns)
    kinds = nodes.select(F.col("campaign_id").alias("source"), F.col("node").alias("target"), "kind")
    return kinds.join(edges.select("source", "target", F.col("label")), ["source", "target"], "left").select("source", "target", "label", "kind")


@register(
    "severe_path",
    f"""
    WITH {TELEMETRY}, h AS (SELECT host, event_id, ts, row_number() OVER (PARTITION BY host ORDER BY ts NULLS FIRST, event_id) AS rn, count(*) OVER (PARTITION BY host) AS n FROM telemetry WHERE severity = 'CRITICAL' AND event_type <> 'file')
    SELECT host, event_id, rn::INTEGER AS step FROM h WHERE n >= 3 AND rn <= 10
    """,
)
def severe_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ten critical events of each host that are not about files."""
    severe = (F.col("severity") == "CRITICAL") & (F.col("event_type") != "file")
    return forensics.critical_path(telemetry(spark, sf_dir), "host", severe, ["ts", "event_id"]).select("host", "event_id", "step")


@register(
    "descendant_levels",
    """
    WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey // 4 AS parent FROM customer WHERE c_custkey >= 4),
    d AS (SELECT node, parent AS ancestor, 1 AS depth FROM t UNION ALL SELECT d.node, t.parent, d.depth + 1 FROM d JOIN t ON t.node = d.ancestor)
    SELECT ancestor, count(*) AS descendants, max(depth)::INTEGER AS depth FROM d GROUP BY ancestor
    """,
)
def descendant_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as processes, parents by number."""
    return forensics.descendants(_t(spark, sf_dir, "customer").filter("c_custkey >= 4").select(F.col("c_custkey").alias("node"), F.expr("c_custkey div 4").alias("parent")))


@register(
    "pattern_agreement",
    """
    WITH p AS (SELECT vec_id, label, CASE WHEN vec_id % 4 > 0 THEN CAST(embedding AS DOUBLE[]) END AS v, ['s' || (vec_id % 3), 's' || (vec_id % 5), 'x'] AS steps, 'p' || (vec_id % 2) AS a, CASE WHEN vec_id % 3 > 0 THEN 'f' END AS f FROM embeddings),
    q AS (SELECT a.vec_id, b.vec_id AS other, a.v AS va, b.v AS vb, a.steps AS sa, b.steps AS sb, a.a = b.a AS same, coalesce(a.f = b.f, false) AS flags FROM p a JOIN p b ON b.vec_id = a.vec_id + 7)
    SELECT vec_id, other, round(100 * CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN list_cosine_similarity(va, vb) ELSE len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb)))::DOUBLE END, 1) AS similarity,
      CASE WHEN same THEN 35 ELSE 0 END + CASE WHEN flags THEN 25 ELSE 0 END AS agreement FROM q
    """,
)
def pattern_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as patterns, each compared with the one seven further: by vector if both have one, else by steps; and equal parts."""
    i, text = F.col("vec_id"), lambda letter, c: F.concat(F.lit(letter), c)
    parts = F.struct(text("p", i % 2).alias("process_ancestry"), F.when(i % 3 > 0, "f").alias("command_flags"), F.lit("").alias("network_destination"), F.lit(None).cast("string").alias("file_activity"))
    p = _t(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(i % 4 > 0, F.col("embedding").cast("array<double>")).alias("v"), F.array(text("s", i % 3), text("s", i % 5), F.lit("x")).alias("steps"), parts.alias("parts")
    )
    other = p.select((i - 7).alias("vec_id"), i.alias("other"), F.col("v").alias("w"), F.col("steps").alias("others"), F.col("parts").alias("theirs"))
    total = F.aggregate(forensics.agreements(F.col("parts"), F.col("theirs")), F.lit(0), lambda acc, x: acc + x["contribution"])
    return p.join(other, "vec_id").select("vec_id", "other", forensics.pattern_similarity(F.col("v"), F.col("w"), F.col("steps"), F.col("others")).alias("similarity"), total.alias("agreement"))


@register(
    "session_intelligence",
    f"""
    WITH {TELEMETRY} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'LIVE' ELSE 'SCENARIO' END AS source_mode, 'COWRIE' AS honeypot, CASE WHEN dst_port = 22 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
      CASE WHEN dst_port = 22 THEN 88 ELSE 40 END AS reputation, concat('Recommend blocking source IP ', src_ip, ' on Perimeter Firewall') AS advice FROM telemetry
    """,
)
def session_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored alerts, as a feed, with a verdict."""
    i = F.col("event_id")
    alerts = telemetry(spark, sf_dir).select(
        F.concat(F.when(i % 2 == 0, "tpot-live-").otherwise("t-"), i).alias("id"), F.col("ts").alias("timestamp"), F.lit("cowrie").alias("type"), "src_ip", F.lit(0).alias("src_port"),
        F.col("dst_port").alias("dest_port"), F.col("command").alias("payload"), F.lit(None).cast("string").alias("status"),
    )
    rows = forensics.with_intelligence(forensics.alert_feed(alerts))
    return rows.select(
        F.regexp_extract("event_id", r"(\d+)$", 1).cast("long").alias("event_id"), "source_mode", "honeypot", "severity", F.col("threat_intelligence.reputation_score").alias("reputation"), F.col("recommendations")[0].alias("advice")
    )
