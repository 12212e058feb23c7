"""Queries of the normaliser, PE chains, pattern store, feedback, indicators and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import verdicts as V
from duskwatch.operators import knowledge as K
from duskwatch.sources import telemetry_events as E

from .registry import register
from .telemetry import TELEMETRY, telemetry


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- raw events: four shapes of JSON by event_id, and some that are no JSON ---


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON of every event: processes, sockets, logons with other key names, files, and a broken line in every 97."""
    e = telemetry(spark, sf_dir)
    shape = F.col("event_id") % 4
    text = lambda c: F.col(c).cast("string")
    data = (
        F.when(shape == 0, F.create_map(F.lit("pid"), text("pid"), F.lit("command"), F.concat("command", F.lit(" -token abc123 x")), F.lit("ProcessName"), F.lit("tool.exe")))
        .when(shape == 1, F.create_map(F.lit("src_ip"), text("src_ip"), F.lit("dest_ip"), text("dst_ip"), F.lit("dest_port"), text("dst_port"), F.lit("protocol"), F.lit("udp")))
        .when(shape == 2, F.create_map(F.lit("username"), text("user_name"), F.lit("logon_kind"), F.lit("Network"), F.lit("status"), F.lit("failed")))
        .otherwise(F.create_map(F.lit("file_name"), F.lit("/tmp/x"), F.lit("sha256"), F.lit("ab12")))
    )
    kind = F.when(shape == 0, F.lit("Process")).when(shape == 1, F.lit("network")).when(shape == 2, F.lit("authentication")).otherwise(F.lit("FILE"))
    record = F.struct(kind.alias("event_type"), text("event_id").alias("event_id"), text("ts").alias("timestamp"), F.col("host").alias("host_id"), text("severity").alias("severity"),
                      F.when(F.col("event_id") % 5 == 0, F.lit("tpot-sensor")).alias("source"), data.alias("event_data"))
    return e.select(F.when(F.col("event_id") % 97 == 96, F.lit("{broken")).otherwise(F.to_json(record)).alias("value"))


_SHAPED = f"""WITH {TELEMETRY}, s AS (SELECT *, event_id % 4 AS shape, CASE WHEN event_id % 5 = 0 THEN 'tpot-sensor' ELSE 'windows' END AS origin FROM telemetry WHERE event_id % 97 <> 96)"""


@register(
    "normalised_events",
    f"""
    {_SHAPED}
    SELECT CAST(event_id AS VARCHAR) AS event_id, CASE shape WHEN 0 THEN 'process' WHEN 1 THEN 'network' WHEN 2 THEN 'authentication' ELSE 'file' END AS event_type, lower(severity) AS severity,
      CASE WHEN shape = 0 THEN pid END AS pid, CASE WHEN shape = 2 THEN user_name END AS "user", CASE WHEN shape = 1 THEN src_ip END AS src_ip,
      CASE WHEN shape = 1 AND dst_ip <> '' THEN dst_ip END AS dst_ip, CASE WHEN shape = 1 AND dst_port <> 0 THEN dst_port END AS dst_port, CASE WHEN shape = 1 THEN 'UDP' END AS protocol,
      CASE WHEN shape = 0 THEN concat(command, ' -token [REDACTED] x') END AS command,
      CASE shape WHEN 0 THEN concat(command, ' -token [REDACTED] x') WHEN 3 THEN '/tmp/x' END AS payload,
      CASE WHEN shape = 1 AND starts_with(dst_ip, '185.') THEN 'PUBLIC/INTERNET' WHEN shape = 1 AND starts_with(dst_ip, '192.168.') THEN 'PRIVATE/LAN' ELSE 'UNKNOWN' END AS ip_classification,
      CASE WHEN shape = 2 THEN 'FAILED' END AS logon_result, CASE WHEN shape = 2 THEN 'Network' END AS logon_type, CASE WHEN shape = 3 THEN 'write' END AS operation,
      CASE WHEN origin = 'tpot-sensor' THEN 'TPOT' ELSE 'LIVE_HOST' END AS source_type,
      concat(origin, '_', CASE shape WHEN 0 THEN 'process' WHEN 1 THEN 'network' WHEN 2 THEN 'authentication' ELSE 'file' END) AS collector, '' AS error
    FROM s
    """,
)
def normalised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = E.parse_raw(raw_lines(spark, sf_dir))
    events = E.flat(E.with_provenance(E.normalise(good)))
    return events.select(
        "event_id", "event_type", "severity", "pid", "user", "src_ip", "dst_ip", "dst_port", "protocol", "command", "payload", "ip_classification",
        F.col("authentication.result").alias("logon_result"), F.col("authentication.logon_type").alias("logon_type"), F.col("file.operation").alias("operation"),
        F.col("provenance")["source_type"].alias("source_type"), F.col("provenance")["collector"].alias("collector"), F.coalesce(E.event_error(events), F.lit("")).alias("error"),
    )


@register(
    "raw_parse_statistics",
    """
    SELECT count(*) FILTER (WHERE event_id % 97 <> 96) AS parsed, count(*) FILTER (WHERE event_id % 97 = 96) AS errors,
      count(*) FILTER (WHERE event_id % 97 <> 96) / count(*) AS success_rate, count(*) FILTER (WHERE event_id % 97 = 96) / count(*) AS error_rate FROM events
    """,
)
def raw_parse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.parse_statistics(*E.parse_raw(raw_lines(spark, sf_dir)))


# --- PE objects: parts as programs, with imported functions by their numbers ---

_APIS = ("CreateFileW", "RegSetValueExA", "HttpSendRequestA", "Sleep", "CreateProcessA", "recvfrom", "TerminateProcess", "DnsQuery")


def _functions() -> Column:
    return F.array(*[F.element_at(F.array(*map(F.lit, _APIS)), ((F.col("p_partkey") + 3 * i) % len(_APIS) + 1).cast("int")) for i in range(3)])


_API_SQL = "list_value(" + ", ".join(f"list_extract([{', '.join(repr(a) for a in _APIS)}], CAST((p_partkey + {3 * i}) % {len(_APIS)} + 1 AS INT))" for i in range(3)) + ")"
_EVENT_OF = """CASE WHEN api = 'CreateFileW' THEN 'file:create' WHEN api = 'RegSetValueExA' THEN 'registry:modify' WHEN api = 'HttpSendRequestA' THEN 'network:connect'
  WHEN api = 'CreateProcessA' THEN 'process:create' WHEN api = 'recvfrom' THEN 'network:receive' WHEN api = 'TerminateProcess' THEN 'process:terminate' END"""


@register(
    "pe_chains",
    f"""
    WITH p AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS h, concat('C:\\Windows\\System32\\', left(sha256(CAST(p_partkey AS VARCHAR)), 16), '.exe') AS path, {_API_SQL} AS apis, p_partkey % 3 = 0 AS packed FROM part),
    a AS (SELECT h, unnest(range(3)) AS i, unnest(apis) AS api FROM p), b AS (SELECT h, i, api, {_EVENT_OF} AS e FROM a),
    r AS (SELECT h, 0 AS rank, 0 AS i, concat('sorel_file_', left(h, 8), '_drop') AS event_id, 'file' AS event_type, 'write' AS action, path AS target, CAST(NULL AS VARCHAR) AS api FROM p
      UNION ALL SELECT h, 1, 0, concat('sorel_proc_', left(h, 8), '_exec'), 'process', 'create', path, NULL FROM p
      UNION ALL SELECT h, 2, 0, concat('sorel_sec_', left(h, 8), '_text'), 'file', 'modify', concat(path, ':.text'), NULL FROM p
      UNION ALL SELECT h, 2, 1, concat('sorel_sec_', left(h, 8), '_UPX0'), 'file', 'modify', concat(path, ':UPX0'), NULL FROM p WHERE packed
      UNION ALL SELECT h, 3, i, concat('sorel_sim_', left(h, 8), '_', split_part(e, ':', 1), '_', i), split_part(e, ':', 1), split_part(e, ':', 2), NULL, api FROM b WHERE e IS NOT NULL)
    SELECT h AS sha256, row_number() OVER (PARTITION BY h ORDER BY rank, i) - 1 AS seq, event_id, event_type, action, target, api FROM r
    """,
)
def pe_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = F.array(
        F.transform(_functions(), lambda f: F.struct(F.lit(None).cast("string").alias("DLL"), f.alias("Name"), F.lit(None).cast("string").alias("Structure"))),
        F.array(F.struct(F.lit("kernel32.dll").alias("DLL"), F.lit("IMAGE").alias("Name"), F.lit("table").alias("Structure"))),
    )
    section = lambda n: F.struct(F.struct(F.lit(n).alias("Value")).alias("Name"))
    sections = F.when(F.col("p_partkey") % 3 == 0, F.array(section(".text\\x00\\x00"), section(".rsrc"), section("UPX0"))).otherwise(F.array(section(".text"), section(".data")))
    objects = _t(spark, sf_dir, "part").select(F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"), symbols.alias("Imported symbols"), sections.alias("PE Sections"))
    return E.metadata_chain(objects)


@register(
    "pe_file_events",
    f"""
    SELECT concat('ember_sim_', left(h, 8), '_file') AS event_id, concat('C:\\Windows\\Temp\\', left(h, 16), '.exe') AS path, coalesce(size, 102400) AS file_size, label, apis AS api_imports FROM
      (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS h, CASE WHEN p_size > 10 THEN p_size END AS size, CASE WHEN p_size % 2 = 1 THEN 'malware' ELSE 'benign' END AS label,
       array_to_string(list_sort(list_distinct({_API_SQL})), ',') AS apis FROM part)
    """,
)
def pe_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.sha2(F.col("p_partkey").cast("string"), 256)
    names = F.array_distinct(_functions())
    imports = F.map_from_arrays(names, F.transform(names, lambda n: F.array(n)))
    objects = _t(spark, sf_dir, "part").select(key.alias("sha256"), (F.col("p_size") % 2).alias("label"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"), imports.alias("imports"))
    found = E.pe_file_events(objects)
    return found.select("event_id", "path", "file_size", "label", F.array_join(F.array_sort("api_imports"), ",").alias("api_imports"))


# --- pattern store: customers as patterns, orders as verdicts of analysts ---

_LOG_SQL = """log AS (SELECT o_custkey AS pattern_id, o_orderkey AS feedback_id, o_orderdate AS ts, o_orderpriority AS analyst,
  CASE o_orderstatus WHEN 'F' THEN 'Analyst Confirmed' WHEN 'O' THEN 'Analyst Rejected' ELSE 'Needs Review' END AS new_status FROM orders)"""


def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", F.lit(K.CONFIRMED)).when(F.col("o_orderstatus") == "O", F.lit(K.REJECTED)).otherwise(F.lit("Needs Review"))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("pattern_id"), F.col("o_orderkey").alias("feedback_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("analyst"), status.alias("new_status")
    )


_HISTORY_SQL = f"""WITH {_LOG_SQL}, h AS (SELECT *, coalesce(lag(new_status) OVER w, 'Unreviewed') AS previous_status FROM log WINDOW w AS (PARTITION BY pattern_id ORDER BY ts, feedback_id)),
  c AS (SELECT *, sum(CASE WHEN new_status = 'Analyst Rejected' AND previous_status <> 'Analyst Rejected' THEN 1 ELSE 0 END) OVER w AS rejected,
    sum(CASE WHEN new_status = 'Analyst Confirmed' AND previous_status <> 'Analyst Confirmed' THEN 1 ELSE 0 END) OVER w AS confirmed, row_number() OVER v AS newest
    FROM h WINDOW w AS (PARTITION BY pattern_id ORDER BY ts, feedback_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY pattern_id ORDER BY ts DESC, feedback_id DESC))"""


@register("pattern_feedback_history", f"{_HISTORY_SQL} SELECT pattern_id, feedback_id, previous_status, new_status, CAST(rejected AS BIGINT) AS false_positive_count, CAST(confirmed AS BIGINT) AS analyst_confirmed_count FROM c")
def pattern_feedback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.feedback_history(verdict_log(spark, sf_dir))
    return found.select("pattern_id", "feedback_id", "previous_status", "new_status", "false_positive_count", "analyst_confirmed_count")


@register(
    "pattern_states",
    f"""
    {_HISTORY_SQL} SELECT c_custkey AS pattern_id, coalesce(new_status, 'Unreviewed') AS validation_status, CAST(coalesce(rejected, 0) AS BIGINT) AS false_positive_count,
      CAST(coalesce(confirmed, 0) AS BIGINT) AS analyst_confirmed_count FROM customer LEFT JOIN (SELECT * FROM c WHERE newest = 1) l ON c_custkey = pattern_id
    """,
)
def pattern_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pattern_id"))
    return K.pattern_states(patterns, verdict_log(spark, sf_dir)).drop("reviewed_at")


@register("pattern_errors", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'no embedding' WHEN vec_id % 10 = 1 THEN 'wrong size' ELSE '' END AS error FROM embeddings")
def pattern_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    planted = F.when(F.col("vec_id") % 10 == 1, F.slice(v, 1, 10)).when(F.col("vec_id") % 10 != 0, v)
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(K.pattern_error(planted, 64), F.lit("")).alias("error"))


@register(
    "analyst_trail",
    f"""
    WITH {_LOG_SQL} SELECT pattern_id AS campaign_id, row_number() OVER (PARTITION BY pattern_id ORDER BY ts, feedback_id) AS entry, concat('ANALYST_', upper(new_status)) AS action, analyst AS actor,
      CASE WHEN feedback_id % 2 = 0 THEN 'seen' ELSE concat('Analyst changed validation status to ', new_status) END AS notes FROM log
    """,
)
def analyst_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = F.when(F.col("feedback_id") % 2 == 0, F.lit("seen")).otherwise(F.lit(""))
    changes = verdict_log(spark, sf_dir).select(F.col("pattern_id").alias("campaign_id"), F.col("feedback_id").alias("change_id"), "ts", F.col("analyst").alias("actor"), F.col("new_status").alias("analyst_status"), notes.alias("notes"))
    return K.analyst_trail(changes).drop("timestamp")


# --- feedback: events as feedback on their users ---

_FEEDBACK_SQL = """f AS (SELECT event_id AS feedback_id, ts, user_id AS profile_id, concat('analyst', event_id % 3) AS analyst_id,
  CASE event_type WHEN 'purchase' THEN 'true_positive' WHEN 'click' THEN 'true_positive' WHEN 'error' THEN 'false_positive' WHEN 'view' THEN 'false_negative' ELSE 'other' END AS feedback_type FROM events)"""


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in {"purchase": "true_positive", "click": "true_positive", "error": "false_positive", "view": "false_negative"}.items() for x in kv]), F.col("event_type")), F.lit("other"))
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), "ts", F.col("user_id").alias("profile_id"), F.concat(F.lit("analyst"), (F.col("event_id") % 3).cast("string")).alias("analyst_id"), kind.alias("feedback_type"))


@register(
    "feedback_summary",
    f"""
    WITH {_FEEDBACK_SQL}, r AS (SELECT * FROM f WHERE ts > (SELECT max(ts) FROM f) - INTERVAL 7 DAY)
    SELECT feedback_type, analyst_id, count(*) AS n, count(*) / 7.0e0 AS per_day FROM r GROUP BY GROUPING SETS ((feedback_type), (analyst_id), ())
    """,
)
def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = feedback_log(spark, sf_dir)
    now = log.agg(F.max("ts").alias("as_of"))
    return K.feedback_summary(log.crossJoin(F.broadcast(now)), F.col("as_of"), 7)


@register(
    "estimated_performance",
    f"""
    WITH {_FEEDBACK_SQL}, c AS (SELECT count(*) FILTER (WHERE feedback_type = 'true_positive') AS tp, count(*) FILTER (WHERE feedback_type = 'false_positive') AS fp, count(*) FILTER (WHERE feedback_type = 'false_negative') AS fn FROM f),
    s AS (SELECT tp / (tp + fp + fn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, tp + fp + fn AS feedback_samples FROM c)
    SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1_score FROM s
    """,
)
def estimated_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.estimated_performance(feedback_log(spark, sf_dir))


@register(
    "feedback_next_actions",
    f"""
    WITH {_FEEDBACK_SQL} SELECT feedback_id, CASE WHEN profile_id % 7 = 0 THEN 'profile_id' WHEN feedback_type = 'other' THEN 'feedback_type' ELSE '' END AS error,
      concat(CASE feedback_type WHEN 'false_negative' THEN 'add_to_training_data,trigger_pattern_learning,review_detection_rules' WHEN 'false_positive' THEN 'adjust_detection_threshold,review_feature_weights,add_to_whitelist'
        WHEN 'true_positive' THEN 'reinforce_pattern,update_campaign_signature' ELSE '' END, CASE WHEN feedback_id % 100 = 0 THEN CASE WHEN feedback_type = 'other' THEN '' ELSE ',' END || 'trigger_model_retraining' ELSE '' END) AS actions FROM f
    """,
)
def feedback_next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = feedback_log(spark, sf_dir)
    profile = F.when(F.col("profile_id") % 7 != 0, F.col("profile_id"))
    error = K.feedback_error(F.col("feedback_type"), profile, F.col("analyst_id"))
    return log.select("feedback_id", F.coalesce(error, F.lit("")).alias("error"), F.array_join(K.next_actions(F.col("feedback_type"), F.col("feedback_id")), ",").alias("actions"))


@register(
    "false_negative_patterns",
    f"""
    WITH {_FEEDBACK_SQL} SELECT concat('fn-', feedback_id) AS pattern_id, CASE WHEN feedback_id % 2 = 0 THEN 'APT' ELSE 'Unknown' END AS threat_class, 0.8e0 AS confidence_score, 'feedback_false_negative' AS source,
      profile_id, v.embedding[1] AS first FROM f JOIN embeddings v ON v.vec_id = profile_id WHERE feedback_type = 'false_negative'
    """,
)
def false_negative_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = feedback_log(spark, sf_dir).withColumn("corrected_label", F.when(F.col("feedback_id") % 2 == 0, F.lit("APT")))
    found = K.false_negative_patterns(log, _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("profile_id"), "embedding"))
    return found.select("pattern_id", "threat_class", "confidence_score", "source", F.col("metadata.profile_id").alias("profile_id"), F.col("embedding")[0].alias("first"))


@register(
    "class_statistics",
    "SELECT c_mktsegment AS threat_class, count(*) AS patterns, avg(c_acctbal) AS mean_confidence FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY ROLLUP (c_mktsegment)",
)
def class_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.class_statistics(_t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("threat_class"), F.col("c_acctbal").alias("confidence_score")))


@register(
    "promoted_campaigns",
    """
    SELECT c_custkey AS campaign_id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE concat('Campaign ', c_custkey) END AS campaign_name, 'BEHAVIORAL' AS threat_class, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen,
      count(o_orderkey) AS detection_count, CASE WHEN c_nationkey % 3 = 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS attribution FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
    """,
)
def promoted_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("campaign_id")).agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.collect_list("o_orderkey").alias("evidence_event_ids"))
    customers = _t(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("campaign_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("campaign_name"), F.lit(None).cast("array<string>").alias("technique_ids"),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("UNKNOWN")).otherwise(F.lit("GROUP")).alias("attribution_type"), F.col("c_mktsegment").alias("attribution_name"),
    )
    return K.promote_campaigns(customers.join(evidence, "campaign_id", "left")).drop("common_techniques")


@register("active_versions", "SELECT o_custkey AS model, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version, max(o_orderdate) AS activated_at FROM orders GROUP BY 1")
def active_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("activated_at"))
    return K.active_versions(log)


@register(
    "settings_with_defaults",
    "SELECT p_name AS setting, coalesce(CAST(s_acctbal AS VARCHAR), p_brand) AS value, s_suppkey IS NOT NULL AS overridden FROM (SELECT DISTINCT ON (p_name) * FROM part ORDER BY p_name, p_partkey) LEFT JOIN supplier ON s_suppkey = p_partkey AND s_suppkey % 2 = 0",
)
def settings_with_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("setting")).agg(F.min(F.struct("p_partkey", "p_brand")).alias("p"))
    stored = _t(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").join(one.select("setting", "p.p_partkey"), F.col("s_suppkey") == F.col("p_partkey")).select("setting", F.col("s_acctbal").cast("string").alias("value"))
    return K.with_defaults(one.select("setting", F.col("p.p_brand").alias("default")), stored)


# --- indicators ---


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One indicator document for each supplier, as the repository keeps them."""
    key = F.col("s_suppkey").cast("string")
    one = lambda value: F.create_map(value, F.col("s_name"))
    documents = _t(spark, sf_dir, "supplier").select(
        one(F.concat(F.lit(" "), F.upper(F.md5(key)))).alias("hashes"), one(F.concat(F.lit("185.220.101."), (F.col("s_suppkey") % 10).cast("string"))).alias("ips"),
        one(F.concat(F.lit("Host"), key, F.lit(".example "))).alias("domains"), one(F.concat(F.lit("http://X/"), (F.col("s_suppkey") % 7).cast("string"))).alias("urls"),
        one(F.concat(F.lit("cve-2024-"), F.lpad(key, 4, "0"))).alias("cves"),
    )
    return K.indicator_rows(documents)


_INDICATOR_SQL = """i AS (SELECT family, value, max(label) AS label FROM (
  SELECT 'hashes' AS family, md5(CAST(s_suppkey AS VARCHAR)) AS value, s_name AS label FROM supplier UNION ALL SELECT 'ips', concat('185.220.101.', s_suppkey % 10), s_name FROM supplier
  UNION ALL SELECT 'domains', lower(concat('Host', s_suppkey, '.example')), s_name FROM supplier UNION ALL SELECT 'urls', concat('http://X/', s_suppkey % 7), s_name FROM supplier
  UNION ALL SELECT 'cves', concat('CVE-2024-', lpad(CAST(s_suppkey AS VARCHAR), 4, '0')), s_name FROM supplier) GROUP BY 1, 2)"""


@register("indicator_rows", f"WITH {_INDICATOR_SQL} SELECT * FROM i")
def indicator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators(spark, sf_dir)


@register("indicator_counts", f"WITH {_INDICATOR_SQL} SELECT coalesce(family, 'total') AS family, count(*) AS n FROM i GROUP BY ROLLUP (family)")
def indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.indicator_counts(indicators(spark, sf_dir))


@register("unlisted_targets", f"WITH {TELEMETRY}, {_INDICATOR_SQL} SELECT dst_ip, count(*) AS n FROM telemetry WHERE dst_ip NOT IN (SELECT value FROM i WHERE family = 'ips' AND value <> '185.220.101.3') GROUP BY 1")
def unlisted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = indicators(spark, sf_dir).filter("family = 'ips' and value <> '185.220.101.3'").select(F.col("value").alias("dst_ip"))
    return K.not_listed(telemetry(spark, sf_dir), listed, "dst_ip").groupBy("dst_ip").agg(F.count("*").alias("n"))


@register(
    "attack_pattern_matches",
    """
    WITH e AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS word FROM documents), k AS (SELECT doc_id, word FROM e WHERE length(word) > 3),
    p AS (SELECT concat('CAPEC-', p_partkey) AS pattern_id, lower(concat(p_name, chr(10), p_type)) AS t FROM part),
    b AS (SELECT concat('CAPEC-x', item_id) AS pattern_id, lower(concat('i', chr(10), text)) AS t FROM benchmark), q AS (SELECT * FROM p UNION ALL SELECT * FROM b),
    w AS (SELECT DISTINCT word FROM k), m AS (SELECT word, pattern_id FROM w JOIN q ON contains(t, word)), f AS (SELECT DISTINCT doc_id, pattern_id FROM k JOIN m USING (word)),
    r AS (SELECT doc_id, pattern_id, row_number() OVER (PARTITION BY doc_id ORDER BY pattern_id) AS rank FROM f),
    g AS (SELECT pattern_id, row_number() OVER (ORDER BY pattern_id) AS rank FROM q WHERE pattern_id IN ('CAPEC-112', 'CAPEC-223', 'CAPEC-66'))
    SELECT * FROM r WHERE rank <= 5 UNION ALL SELECT d.doc_id, g.pattern_id, g.rank FROM (SELECT DISTINCT doc_id FROM e) d, g WHERE d.doc_id NOT IN (SELECT doc_id FROM f)
    """,
)
def attack_pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower("text"), " "))
    evidence = _t(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("keyword"))
    parts = _t(spark, sf_dir, "part").select(F.concat(F.lit("CAPEC-"), F.col("p_partkey").cast("string")).alias("pattern_id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    items = _t(spark, sf_dir, "benchmark").select(F.concat(F.lit("CAPEC-x"), F.col("item_id").cast("string")).alias("pattern_id"), F.lit("i").alias("name"), F.col("text").alias("description"))
    return K.pattern_matches(evidence, "doc_id", parts.unionByName(items))


# --- verdicts ---


@register(
    "verdict_texts",
    """
    WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'APT' WHEN 1 THEN 'Ransomware' ELSE 'Phishing' END AS threat, (o_orderkey % 10) / 10.0e0 AS novelty, o_orderkey % 3 = 0 AS moves, o_orderkey % 5 = 0 AS leak,
      (o_orderkey % 7) / 7.0e0 AS confidence FROM orders),
    f AS (SELECT *, concat_ws('; ', CASE WHEN threat IN ('APT', 'Ransomware') THEN concat('High-severity threat class (', threat, ')') END,
      CASE WHEN novelty > 0.8e0 THEN 'Potential zero-day attack (highly novel behavior)' WHEN novelty > 0.5e0 THEN 'Variant attack behavior (moderately novel)' END, CASE WHEN moves THEN 'Lateral movement detected' END,
      CASE WHEN leak THEN 'Data exfiltration detected' END, CASE WHEN confidence < 0.5e0 THEN printf('Low confidence (%.2f) reduces reliability', confidence) END) AS factors FROM v)
    SELECT o_orderkey, CASE WHEN factors <> '' THEN concat('Risk assessment based on: ', factors) ELSE concat('Standard risk assessment for ', threat, ' threat') END AS rationale,
      round(novelty - confidence, 2) AS risk_delta, CASE WHEN confidence < novelty THEN 'DECREASING' ELSE 'STABLE' END AS risk_trend FROM f
    """,
)
def verdict_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    threat = F.when(k % 4 == 0, F.lit("APT")).when(k % 4 == 1, F.lit("Ransomware")).otherwise(F.lit("Phishing"))
    novelty, confidence = (k % 10) / F.lit(10.0), (k % 7) / F.lit(7.0)
    trend = V.risk_trend(novelty, confidence)
    return _t(spark, sf_dir, "orders").select(k, V.rationale(threat, novelty, k % 3 == 0, k % 5 == 0, confidence).alias("rationale"), trend["risk_delta"].alias("risk_delta"), trend["risk_trend"].alias("risk_trend"))


@register(
    "campaign_classes",
    """
    WITH c AS (SELECT c_custkey, concat(CASE c_custkey % 8 WHEN 0 THEN 'Advanced-' WHEN 1 THEN 'crypto.' WHEN 2 THEN 'EMPLOYEE' WHEN 3 THEN 'trojan' WHEN 4 THEN 'social' WHEN 5 THEN 'phish-apt' ELSE 'x' END, c_custkey) AS id FROM customer)
    SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'APT' WHEN 1 THEN 'Ransomware' WHEN 2 THEN 'Insider_Threat' WHEN 3 THEN 'Malware' WHEN 4 THEN 'Phishing' WHEN 5 THEN 'APT' ELSE 'Malware' END AS threat_class FROM c
    """,
)
def campaign_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("Advanced-", "crypto.", "EMPLOYEE", "trojan", "social", "phish-apt", "x", "x")])
    name = F.concat(F.element_at(words, (F.col("c_custkey") % 8 + 1).cast("int")), F.col("c_custkey").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", V.campaign_class(name).alias("threat_class"))


@register(
    "user_attack_stages",
    f"""
    WITH {TELEMETRY}, m AS (SELECT user_id, CASE event_type WHEN 'authentication' THEN 'initial_access' WHEN 'powershell' THEN 'execution' WHEN 'process' THEN 'persistence' WHEN 'file' THEN 'collection' ELSE 'exfiltration' END AS tactic, event_id % 50 AS part FROM telemetry),
    u AS (SELECT user_id, part, list(DISTINCT tactic) AS tactics, count(*) AS n FROM m GROUP BY 1, 2)
    SELECT user_id, part, CASE WHEN len(list_intersect(tactics, ['lateral_movement', 'collection', 'exfiltration', 'impact'])) >= 2 OR n > 50 THEN 'advanced'
      WHEN len(list_intersect(tactics, ['execution', 'persistence', 'privilege_escalation', 'discovery'])) >= 2 OR n > 20 THEN 'intermediate' ELSE 'initial' END AS stage,
      CASE WHEN list_contains(tactics, 'execution') THEN 'T1059,T1569,T1053' ELSE '' END AS execution_techniques FROM u
    """,
)
def user_attack_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = {"authentication": "initial_access", "powershell": "execution", "process": "persistence", "file": "collection"}
    tactic = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("event_type")), F.lit("exfiltration"))
    groups = telemetry(spark, sf_dir).groupBy("user_id", (F.col("event_id") % 50).alias("part")).agg(F.collect_set(tactic).alias("tactics"), F.count("*").alias("n"))
    executed = F.filter("tactics", lambda t: t == "execution")
    return groups.select("user_id", "part", V.attack_stage(F.col("tactics"), F.col("n")).alias("stage"), F.array_join(V.techniques_in_order(executed), ",").alias("execution_techniques"))


@register(
    "script_verdicts",
    f"""
    WITH {TELEMETRY}, s AS (SELECT event_id, concat(command, CASE event_id % 6 WHEN 0 THEN ' IEX (New-Object).DownloadString' WHEN 1 THEN ' VirtualAlloc' WHEN 2 THEN ' amsiUtils System.Reflection' ELSE '' END) AS t FROM telemetry),
    m AS (SELECT event_id, CAST(regexp_matches(t, '(?i)Invoke-Expression|iex\\s') AS INT) + CAST(regexp_matches(t, '(?i)DownloadString|DownloadFile') AS INT) + CAST(regexp_matches(t, '(?i)VirtualAlloc|WriteProcessMemory|CreateThread') AS INT)
      + CAST(regexp_matches(t, '(?i)Reflect\\.Assembly|System\\.Reflection') AS INT) + CAST(regexp_matches(t, '(?i)amsiUtils|amsiInitFailed') AS INT) AS matched FROM s)
    SELECT event_id, matched, CASE WHEN matched >= 2 THEN 0.88e0 WHEN matched = 1 THEN 0.45e0 ELSE 0.10e0 END AS score, CASE WHEN matched >= 2 THEN 'Heuristic.ObfuscatedScript' WHEN matched = 1 THEN 'Heuristic.SuspiciousCmdlet' END AS threat FROM m
    """,
)
def script_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.expr("concat(command, CASE event_id % 6 WHEN 0 THEN ' IEX (New-Object).DownloadString' WHEN 1 THEN ' VirtualAlloc' WHEN 2 THEN ' amsiUtils System.Reflection' ELSE '' END)")
    return telemetry(spark, sf_dir).select("event_id", V.script_verdict(planted).alias("v")).select("event_id", "v.matched", "v.score", "v.threat")


@register(
    "vector_intents",
    """
    WITH d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings), s AS (SELECT vec_id, t, avg(abs(CAST(x AS DOUBLE))) AS score FROM d, range(13) r(t)
      WHERE i >= (t * 10) % 64 AND i < least((t * 10) % 64 + 10, 64) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, t) AS rank FROM s)
    SELECT vec_id, ['reconnaissance', 'initial_access', 'execution', 'persistence', 'privilege_escalation', 'defense_evasion', 'credential_access', 'discovery', 'lateral_movement', 'collection', 'exfiltration', 'impact',
      'command_and_control'][t + 1] AS tactic, round(score, 9) AS score FROM k WHERE rank = 1
    """,
)
def vector_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = V.intents(F.col("embedding").cast("array<double>"), 64)[0]
    return _t(spark, sf_dir, "embeddings").select("vec_id", best["tactic"].alias("tactic"), F.round(best["score"], 9).alias("score"))


@register(
    "component_views",
    """
    WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    c AS (SELECT vec_id, list_cosine_similarity(x[1:22], y[1:22]) AS s, list_cosine_similarity(x[23:34], y[23:34]) AS t, list_cosine_similarity(x[35:64], y[35:64]) AS m, list_cosine_similarity(x, y) AS o FROM p)
    SELECT vec_id, round((s + 1) / 2, 4) AS structural, round((t + 1) / 2, 4) AS temporal, round((m + 1) / 2, 4) AS semantic, round((o + 1) / 2, 4) AS overall, round(0.5 * (s + 1) / 2 + 0.5 * (m + 1) / 2, 4) AS weighted, round(1 - o, 4) AS distance FROM c
    """,
)
def component_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    x, y = F.col("x"), F.col("y")
    view = V.component_view(x, y, {"structural": (0, 22), "temporal": (22, 34), "semantic": (34, 64)})
    both = V.component_similarity(x, y, [(0, 22), (34, 64)], [0.5, 0.5])
    out = pairs.select("vec_id", view.alias("v"), both.alias("w"))
    return out.select("vec_id", *[F.round(F.col(f"v.{n}"), 4).alias(n) for n in ("structural", "temporal", "semantic", "overall")], F.round("w", 4).alias("weighted"), F.round(V.as_distance(2 * F.col("v.overall") - 1), 4).alias("distance"))
