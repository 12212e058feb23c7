"""Queries of stored records: searches, decoded profiles, constructors, checks, appends and upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import verdicts
from duskwatch.operators import knowledge, records
from duskwatch.operators.steps import shared_dir

from .reader_queries import write_apart
from .registry import register
from .telemetry import TELEMETRY, telemetry
from .vector_queries import _E


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "campaign_search",
    """
    SELECT 'CMP-' || o_orderkey AS campaign_id, o_orderdate AS last_seen FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'O' AND (contains('cmp-' || o_orderkey, '5') OR contains('10.0.0.' || (o_custkey % 50), '5') OR contains('t' || (o_orderkey % 7), '5'))
    """,
)
def campaign_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as campaigns: one mode, one status, one text in four columns."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(
        F.concat(F.lit("CMP-"), k).alias("campaign_id"), F.lit("name").alias("campaign_name"), F.array(F.concat(F.lit("T"), k % 7)).alias("technique_ids"), F.array(F.concat(F.lit("10.0.0."), F.col("o_custkey") % 50)).alias("source_ips"),
        F.when(k % 2 == 0, "Live").otherwise("SCENARIO").alias("source_mode"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("last_seen"),
    )
    return records.search_campaigns(rows, "live", status="O", text="5").select("campaign_id", "last_seen")


@register("profile_lookup", "SELECT 'P7' AS profile_id, event_type AS kind, event_id::VARCHAR AS id, CASE WHEN event_id % 2 = 0 THEN 'host-1' END AS host, 2 AS n_events FROM events WHERE user_id % 10 = 7")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored analyses of ten profiles; the device of every second one can't be read."""
    i = F.col("event_id")
    history = _t(spark, sf_dir, "events").select(
        F.concat(F.lit("P"), F.col("user_id") % 10).alias("profile_id"), F.to_json(F.struct("event_type", "event_id")).alias("profile_json"),
        F.when(i % 2 == 0, '{"host": "host-1"}').otherwise("{broken").alias("device_metadata"), F.lit('[{"a": 1}, {"b": "x"}]').alias("events"),
    )
    got = records.profile(history, "P7")
    at = lambda c, k: F.try_element_at(c, F.lit(k))
    return got.select("profile_id", at("profile", "event_type").alias("kind"), at("profile", "event_id").alias("id"), at("device_metadata", "host").alias("host"), F.size("events").alias("n_events"))


@register(
    "event_records",
    f"""
    WITH {TELEMETRY} SELECT event_id, 'process' AS event_type, '[' || array_to_string(list_sort(list_filter(['pid=' || pid, 'action=create', CASE WHEN pid % 3 > 0 THEN 'parent_pid=' || (pid % 3) END, 'name=x'], lambda x: x IS NOT NULL)), ', ') || ']' AS data FROM telemetry
    UNION ALL SELECT event_id, 'network', '[' || array_to_string(list_sort(list_filter(['action=connect', 'source_ip=' || src_ip, CASE WHEN dst_ip <> '' THEN 'dest_ip=' || dst_ip END, CASE WHEN dst_port > 0 THEN 'dest_port=' || dst_port END], lambda x: x IS NOT NULL)), ', ') || ']' FROM telemetry
    UNION ALL SELECT event_id, 'auth', '[' || array_to_string(list_sort(list_filter(['user=' || user_name, 'action=login', CASE event_id % 3 WHEN 0 THEN 'success=false' WHEN 1 THEN 'success=true' END], lambda x: x IS NOT NULL)), ', ') || ']' FROM telemetry
    UNION ALL SELECT event_id, 'file', '[' || array_to_string(list_sort(['path=' || command, 'action=read']), ', ') || ']' FROM telemetry
    """,
)
def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four records of each event; what is missing stays out of the data."""
    t, i = telemetry(spark, sf_dir), F.col("event_id")
    made = [
        records.event_record("process", i, F.col("ts"), {"pid": F.col("pid"), "action": F.lit("create"), "name": F.lit("x"), "command_line": F.lit(""), "parent_pid": F.col("pid") % 3}),
        records.event_record("network", i, F.col("ts"), {"action": F.lit("connect"), "source_ip": F.col("src_ip"), "dest_ip": F.col("dst_ip"), "dest_port": F.col("dst_port")}),
        records.event_record("auth", i, F.col("ts"), {"user": F.col("user_name"), "action": F.lit("login"), "success": F.when(i % 3 == 0, False).when(i % 3 == 1, True)}),
        records.event_record("file", i, F.col("ts"), {"path": F.col("command"), "action": F.lit("read"), "file_size": F.lit(0)}),
    ]
    rows = t.select(F.explode(F.array(*made)).alias("r")).select("r.*")
    pairs = F.array_sort(F.transform(F.map_entries("event_data"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("event_id", "event_type", F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")).alias("data"))


@register(
    "scan_findings",
    f"""
    WITH {TELEMETRY}, n AS (SELECT CASE event_id % 9 WHEN 0 THEN 'NC.exe' WHEN 1 THEN 'mimikatz.exe' ELSE 'nc' END AS name, dst_port FROM telemetry)
    SELECT 'process' AS finding, lower(name) AS subject, count(*) AS n FROM n WHERE name <> 'nc' GROUP BY ALL UNION ALL SELECT 'connection', '4444', count(*) FROM n WHERE dst_port = 4444
    """,
)
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ports that a scan reports."""
    t = telemetry(spark, sf_dir).withColumn("name", F.when(F.col("event_id") % 9 == 0, "NC.exe").when(F.col("event_id") % 9 == 1, "mimikatz.exe").otherwise("nc"))
    return records.scan_findings(t, t.withColumnRenamed("dst_port", "remote_port"))


@register(
    "bulk_patterns",
    """
    SELECT count(*) FILTER (WHERE vec_id % 9 > 0) AS added, count(*) FILTER (WHERE vec_id % 9 = 0) AS refused, count(*) FILTER (WHERE vec_id % 9 > 0) - 5 AS growth,
      CASE WHEN count(*) FILTER (WHERE vec_id % 9 > 0) - 5 >= 100 THEN 'kb_growth,' ELSE '' END || 'performance_degradation' AS triggers, true AS retrain FROM embeddings
    """,
)
def bulk_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors appended as patterns, every ninth too short; then what calls for training."""
    v = F.col("embedding").cast("array<double>")
    rows = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pattern_id"), F.when(F.col("vec_id") % 9 == 0, F.slice(v, 1, 3)).otherwise(v).alias("embedding"))
    return records.bulk_append(rows, _folder(spark, "patterns"), before=5, accuracy=0.8, baseline=0.9, size=64).withColumn("triggers", F.array_join("triggers", ","))


@register("watch_list", f"WITH {TELEMETRY} SELECT dst_ip AS value, max(severity) AS reason, count(*) AS entries FROM telemetry WHERE dst_ip <> '' GROUP BY 1")
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets put on the watch list, all at one time."""
    path = _folder(spark, "watch")
    records.watch(telemetry(spark, sf_dir).select(F.concat(F.lit(" "), "dst_ip").alias("value"), F.col("severity").alias("reason")), path)
    return records.watched(spark, path)


@register(
    "recommended_playbooks",
    f"""
    WITH {TELEMETRY}, c AS (SELECT source_mode, count(*) FILTER (WHERE contains(lower(command), 'powershell') OR event_type = 'powershell') AS shell, count(*) FILTER (WHERE event_type = 'network' OR dst_ip <> '') AS socket FROM telemetry WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT * FROM (SELECT source_mode, 'Suspicious PowerShell Containment' AS playbook, shell AS events FROM c UNION ALL SELECT source_mode, 'SSH Brute Force & Outbound IP Containment', socket FROM c) WHERE events > 0 OR source_mode = 'SCENARIO'
    """,
)
def recommended_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playbooks for each kind of source."""
    return records.playbooks(telemetry(spark, sf_dir).filter("event_id % 2 = 0"))


@register(
    "upkeep",
    """
    WITH a AS (SELECT max(ts) AS t FROM events), p AS (SELECT count(*) AS patterns FROM part), v AS (SELECT count(*) AS versions, arg_max(s_suppkey, s_suppkey % 11 * 100000 + s_suppkey) AS active_version FROM supplier),
    f AS (SELECT count(*) AS recent_feedback FROM events, a WHERE ts > t - INTERVAL 7 DAY)
    SELECT *, patterns - 50 AS growth, concat_ws(',', CASE WHEN patterns > 10000 THEN 'apply retention' END, CASE WHEN versions > 10 THEN 'clean up versions' END, CASE WHEN patterns - 50 >= 100 THEN 'retrain' END) AS due FROM p, v, f
    """,
)
def upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as patterns, suppliers as versions, events as feedback."""
    versions = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("version"), (F.col("s_suppkey") % 11).alias("activated_at"))
    events = _t(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    feedback = events.select("ts").crossJoin(F.broadcast(newest))
    return records.upkeep(_t(spark, sf_dir, "part"), versions, feedback, F.col("newest"), 50).withColumn("due", F.array_join("due", ","))


@register(
    "score_checks",
    """
    SELECT CASE WHEN coalesce(value / 100 NOT BETWEEN 0 AND 1, true) THEN 'similarity_score' WHEN (event_id % 13) / 12e0 > 1 OR event_id % 13 = 12 AND event_id % 5 = 0 THEN 'novelty_score' WHEN event_id % 17 = 0 THEN 'evidence_quality' WHEN event_id % 19 = 0 THEN 'knowledge_base_size' END AS error, count(*) AS n
    FROM events GROUP BY ALL
    """,
)
def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First score out of range of each event."""
    i = F.col("event_id")
    error = knowledge.score_error(
        F.col("value") / 100, F.when((i % 13 == 12) & (i % 5 == 0), 1.5).otherwise((i % 13) / 12.0), F.when(i % 17 == 0, None).otherwise(0.5), F.when(i % 19 == 0, -1).otherwise(3)
    )
    return _t(spark, sf_dir, "events").groupBy(error.alias("error")).agg(F.count("*").alias("n"))


@register("pattern_by_fingerprint", "SELECT p_partkey FROM part WHERE p_partkey = 17 OR p_size = 17")
def pattern_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose id or size, as fingerprint, is asked for."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("pattern_id"), F.col("p_size").cast("string").alias("fingerprint"))
    return knowledge.by_id_or_fingerprint(rows, "17").select("p_partkey")


@register("file_indicators", "SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS found FROM events")
def file_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a hash among metadata or features."""
    i = F.col("event_id")
    metadata = F.when(i % 3 == 0, F.create_map(F.lit("sha256"), F.lit("x"))).when(i % 3 == 1, F.create_map(F.lit("other"), F.lit("x")))
    features = F.array(F.lit("short"), F.when(i % 5 == 0, F.sha2(i.cast("string"), 256)))
    return _t(spark, sf_dir, "events").select("event_id", F.coalesce(verdicts.has_file_indicator(metadata, features), F.lit(False)).alias("found"))


@register(
    "vector_extremes",
    f"""
    WITH {_E}, x AS (SELECT vec_id, unnest(range(64)) AS i, abs(unnest(v)) * 8 AS size FROM e WHERE vec_id % 10 = 9)
    SELECT vec_id, i AS dim, round(size, 6) AS size, round(1 - size / 100, 6) AS similarity FROM x WHERE size > 0.8 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY i) <= 5
    """,
)
def vector_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five large places of novel vectors; every tenth is novel enough."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 8)
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.explode(verdicts.extremes(v, (F.col("vec_id") % 10) / 10.0)).alias("e"))
    return rows.select("vec_id", F.col("e.dim").cast("long").alias("dim"), F.round("e.size", 6).alias("size"), F.round(verdicts.as_similarity(F.col("e.size") / 100), 6).alias("similarity"))


@register(
    "indicator_documents",
    """
    SELECT 'hashes' AS family, 'ab' || s_suppkey AS value, 'bad' AS label FROM supplier UNION ALL SELECT 'ips', '10.0.' || (s_suppkey // 250) || '.' || (s_suppkey % 250), 'seen' FROM supplier UNION ALL SELECT 'cves', 'CVE-' || s_suppkey, 'known' FROM supplier
    """,
)
def indicator_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of indicators: read, saved as one table with a folder for each family, read again."""
    s, one = F.col("s_suppkey"), lambda k, v: F.create_map(k, F.lit(v))
    body = F.to_json(F.struct(
        one(F.concat(F.lit(" AB"), s), "bad").alias("hashes"), one(F.concat(F.lit("10.0."), F.floor(s / 250), F.lit("."), s % 250), "seen").alias("ips"), one(F.concat(F.lit("cve-"), s), "known").alias("cves"),
    ))
    documents, table = _folder(spark, "indicators"), _folder(spark, "indicators")
    write_apart(_t(spark, sf_dir, "supplier").select(body.alias("value")), documents)
    knowledge.save_indicators(knowledge.read_indicators(spark, documents), table)
    return spark.read.parquet(table).select("family", "value", "label")
