"""Queries over the telemetry view: searches, aggregates, campaigns, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.functions import net, text
from duskwatch.functions.stats import count_where
from duskwatch.operators import campaigns as C
from duskwatch.operators import filters, sets, windows

from .registry import register
from .telemetry import TELEMETRY, telemetry

_HAS = lambda c, *w: "(" + " OR ".join(f"contains(lower({c}), '{x}')" for x in w) + ")"
_NUMBER = "CASE WHEN regexp_matches(dst_ip, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN list_reduce(list_transform(string_split(dst_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) END"
_RANGES = " OR ".join(f"({_NUMBER}) BETWEEN {net._as_number(a)} AND {net._as_number(a) + (1 << b) - 1}" for a, b in net.PRIVATE_RANGES)
_PRIVATE = f"coalesce({_RANGES}, true)"
_TOKENS = "list_has_any(regexp_split_to_array(translate(lower(command), '-/\\', '   '), '\\s+'), [" + ", ".join(f"'{w}'" for w in C.SUSPICIOUS) + "])"
_THREAT = f"(severity IN ('HIGH', 'CRITICAL') OR {_HAS('command', 'enc', 'mimikatz', 'sh.bin')})"


def _threat():
    return F.col("severity").isin("HIGH", "CRITICAL") | text.has(F.col("command"), "enc", "mimikatz", "sh.bin")


@register(
    "overview",
    f"""
    WITH {TELEMETRY}
    SELECT count(*) AS n_events, count(DISTINCT split_part(command, ' ', 1)) AS n_processes,
           count(DISTINCT CASE WHEN dst_ip <> '' THEN concat(dst_ip, ':', CASE WHEN dst_port = 0 THEN 80 ELSE dst_port END) END) AS n_sockets,
           count(*) FILTER (WHERE {_THREAT}) AS n_threats, min(ts) AS first_ts, max(ts) AS last_ts
    FROM telemetry
    """,
)
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    port = F.when(F.col("dst_port") == 0, 80).otherwise(F.col("dst_port"))
    return telemetry(spark, sf_dir).agg(
        F.count("*").alias("n_events"),
        F.countDistinct(F.split_part("command", F.lit(" "), F.lit(1))).alias("n_processes"),
        F.countDistinct(F.when(F.col("dst_ip") != "", F.concat("dst_ip", F.lit(":"), port))).alias("n_sockets"),
        count_where(_threat()).alias("n_threats"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


@register(
    "freshness",
    f"""
    WITH {TELEMETRY}, a AS (SELECT max(ts) AS as_of FROM telemetry)
    SELECT source_mode, max(ts) AS last_ts, max(ts) < min(as_of) - INTERVAL 30 MINUTE AS stale,
           max(ts) >= min(as_of) - INTERVAL 900 SECOND AS fresh
    FROM telemetry, a GROUP BY source_mode
    """,
)
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    last = t.groupBy("source_mode").agg(F.max("ts").alias("last_ts"))
    now = last.agg(F.max("last_ts").alias("as_of"))
    return last.crossJoin(F.broadcast(now)).select(
        "source_mode",
        "last_ts",
        (F.col("last_ts") < F.col("as_of") - F.expr("INTERVAL 30 MINUTES")).alias("stale"),
        (F.col("last_ts") >= F.col("as_of") - F.expr("INTERVAL 900 SECONDS")).alias("fresh"),
    )


@register(
    "threats_over_time",
    f"""
    WITH {TELEMETRY}, a AS (SELECT max(ts) AS as_of FROM telemetry),
    spine AS (SELECT unnest(range(7)) AS bucket),
    b AS (SELECT t.*, CAST(floor((epoch(as_of) - epoch(ts)) / 86400) AS BIGINT) AS bucket FROM telemetry t, a WHERE ts < as_of AND ts >= as_of - INTERVAL 7 DAY),
    g AS (SELECT bucket, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
          count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS low,
          count(*) FILTER (WHERE contains(event_type, 'powershell') OR contains(command, 'powershell')) AS powershell
          FROM b GROUP BY bucket)
    SELECT spine.bucket, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
           coalesce(powershell, 0) AS powershell, coalesce(critical, 0) + coalesce(high, 0) AS threats
    FROM spine LEFT JOIN g ON spine.bucket = g.bucket
    """,
)
def threats_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven half-open daily buckets that end at the newest event; empty buckets give zeros."""
    t = telemetry(spark, sf_dir)
    now = F.broadcast(t.agg(F.max("ts").alias("as_of")))
    age = windows.seconds_between(F.col("ts"), F.col("as_of"))
    inside = t.crossJoin(now).filter((F.col("ts") < F.col("as_of")) & (F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 7 DAYS")))
    s = F.col("severity")
    counts = inside.groupBy(F.floor(age / 86400).alias("bucket")).agg(
        F.count_if(s == "CRITICAL").alias("critical"),
        F.count_if(s == "HIGH").alias("high"),
        F.count_if(s == "MEDIUM").alias("medium"),
        F.count_if(~s.isin("CRITICAL", "HIGH", "MEDIUM")).alias("low"),
        F.count_if(text.has(F.col("event_type"), "powershell") | text.has(F.col("command"), "powershell")).alias("powershell"),
    )
    filled = spark.range(7).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    return filled.withColumn("threats", F.col("critical") + F.col("high"))


@register(
    "threat_class_share",
    f"""
    WITH {TELEMETRY}, c AS (
      SELECT CASE WHEN {_HAS('command', 'powershell', 'bash', 'cmd.exe')} OR contains(event_type, 'powershell') THEN 'Execution'
                  WHEN {_HAS('command', 'mimikatz', 'lsass', 'login')} THEN 'Credential Access'
                  WHEN NOT ({_PRIVATE}) OR {_HAS('command', 'c2')} THEN 'Command & Control'
                  WHEN {_HAS('command', 'whoami', 'netstat', 'ipconfig')} THEN 'Discovery / Reconnaissance'
                  WHEN contains(event_type, 'file') OR {_HAS('command', 'sh.bin')} THEN 'Malware / File Modification'
                  WHEN {_HAS('command', 'enc', 'bypass')} THEN 'Defense Evasion' END AS threat_class FROM telemetry)
    SELECT threat_class, count(*) AS n, count(*) * 100.0e0 / sum(count(*)) OVER () AS share FROM c WHERE threat_class IS NOT NULL GROUP BY threat_class
    """,
)
def threat_class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = C.threat_class(F.col("event_type"), F.col("command"), net.is_private(F.col("dst_ip")), F.lit(None).cast("string"))
    counts = telemetry(spark, sf_dir).select(kind.alias("threat_class")).filter("threat_class is not null").groupBy("threat_class").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


@register(
    "top_processes",
    f"""
    WITH {TELEMETRY}
    SELECT split_part(command, ' ', 1) AS process, count(*) AS n, count(*) * 1.5e0 AS rate, count(*) * 1.5e0 - 3.0e0 AS deviation
    FROM telemetry GROUP BY 1 ORDER BY n DESC, process LIMIT 6
    """,
)
def top_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = telemetry(spark, sf_dir).groupBy(F.split_part("command", F.lit(" "), F.lit(1)).alias("process")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "process").limit(6)
    return top.withColumn("rate", F.col("n") * 1.5).withColumn("deviation", F.col("rate") - 3.0)


@register(
    "top_destinations",
    f"""
    WITH {TELEMETRY}
    SELECT dst_ip, count(*) AS n, {_PRIVATE} AS private FROM telemetry WHERE dst_ip <> '' GROUP BY dst_ip ORDER BY n DESC, dst_ip LIMIT 6
    """,
)
def top_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = telemetry(spark, sf_dir).filter("dst_ip <> ''").groupBy("dst_ip").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "dst_ip").limit(6).withColumn("private", net.is_private(F.col("dst_ip")))


@register(
    "ip_classes",
    f"""
    WITH {TELEMETRY}, n AS (SELECT dst_ip, {_NUMBER} AS number, {_PRIVATE} AS private FROM telemetry)
    SELECT CASE WHEN number IS NULL THEN 'UNKNOWN' WHEN number BETWEEN 2130706432 AND 2147483647 THEN 'LOOPBACK'
                WHEN private THEN 'PRIVATE/LAN' ELSE 'PUBLIC/INTERNET' END AS ip_class, count(*) AS n
    FROM n GROUP BY 1
    """,
)
def ip_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).groupBy(net.ip_class(F.col("dst_ip")).alias("ip_class")).agg(F.count("*").alias("n"))


@register(
    "coverage",
    f"""
    WITH {TELEMETRY}
    SELECT avg(CASE WHEN ts IS NOT NULL THEN 1 ELSE 0 END) * 100 AS with_ts, avg(CASE WHEN command <> '' THEN 1 ELSE 0 END) * 100 AS with_process,
           avg(CASE WHEN dst_ip <> '' THEN 1 ELSE 0 END) * 100 AS with_network, avg(CASE WHEN user_name <> '' THEN 1 ELSE 0 END) * 100 AS with_user
    FROM telemetry
    """,
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(c.cast("int")) * 100
    return telemetry(spark, sf_dir).agg(
        share(F.col("ts").isNotNull()).alias("with_ts"),
        share(F.col("command") != "").alias("with_process"),
        share(F.col("dst_ip") != "").alias("with_network"),
        share(F.col("user_name") != "").alias("with_user"),
    )


@register(
    "telemetry_stats",
    f"""
    WITH {TELEMETRY}
    SELECT source_mode, count(*) AS total, count(*) FILTER (WHERE event_type = 'process') AS process, count(*) FILTER (WHERE event_type = 'network') AS network,
           count(*) FILTER (WHERE event_type = 'file') AS file, count(*) FILTER (WHERE event_type = 'powershell') AS powershell,
           count(*) FILTER (WHERE event_type = 'authentication') AS authentication
    FROM telemetry GROUP BY source_mode
    """,
)
def telemetry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("process", "network", "file", "powershell", "authentication")
    return telemetry(spark, sf_dir).groupBy("source_mode").agg(F.count("*").alias("total"), *[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


@register(
    "collector_health",
    f"""
    WITH {TELEMETRY}, a AS (SELECT max(ts) AS as_of FROM telemetry)
    SELECT collector, count(*) AS n, max(ts) AS last_ts, count(*) FILTER (WHERE ts >= as_of - INTERVAL 1 HOUR) / 3600.0e0 AS eps
    FROM telemetry, a GROUP BY collector
    """,
)
def collector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    now = F.broadcast(t.agg(F.max("ts").alias("as_of")))
    recent = F.col("ts") >= F.col("as_of") - F.expr("INTERVAL 1 HOUR")
    return t.crossJoin(now).groupBy("collector").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"), (F.count_if(recent) / 3600.0).alias("eps"))


@register(
    "telemetry_search",
    f"""
    WITH {TELEMETRY}
    SELECT event_id, ts, command FROM telemetry WHERE upper(source_mode) = 'LIVE' AND upper(event_type) = 'NETWORK' AND contains(lower(command), 'wget')
    ORDER BY ts DESC, event_id LIMIT 50
    """,
)
def telemetry_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.search(telemetry(spark, sf_dir), {"source_mode": "live", "event_type": "network", "severity": None}, "wget", ("command",))
    return found.orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "command")


@register("telemetry_lookup", f"WITH {TELEMETRY} SELECT event_id, ts, src_ip, dst_ip, command FROM telemetry WHERE event_id = 17")
def telemetry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).filter("event_id = 17").select("event_id", "ts", "src_ip", "dst_ip", "command")


@register(
    "time_range_counts",
    f"""
    WITH {TELEMETRY}, a AS (SELECT max(ts) AS as_of FROM telemetry), r(name, width) AS (VALUES ('15m', INTERVAL 15 MINUTE), ('1h', INTERVAL 1 HOUR), ('6h', INTERVAL 6 HOUR), ('24h', INTERVAL 24 HOUR), ('7d', INTERVAL 7 DAY), ('all', INTERVAL 36500 DAY))
    SELECT name, count(*) FILTER (WHERE ts IS NULL OR ts >= as_of - width) AS n FROM telemetry, a, r GROUP BY name
    """,
)
def time_range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*filters.RANGES, "all")
    t = telemetry(spark, sf_dir)
    now = F.broadcast(t.agg(F.max("ts").alias("as_of")))
    wide = t.crossJoin(now).agg(*[F.count_if(filters.in_time_range(F.col("ts"), F.col("as_of"), n)).alias(n) for n in names])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.*")


@register(
    "action_validity",
    f"""
    WITH {TELEMETRY}, a AS (SELECT event_id, CASE event_type WHEN 'authentication' THEN 'auth' ELSE event_type END AS kind, CASE event_id % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'READ' WHEN 2 THEN 'login' WHEN 3 THEN 'dns' WHEN 4 THEN 'rename' WHEN 5 THEN 'terminate' ELSE 'fly' END AS action FROM telemetry)
    SELECT kind, action, (kind = 'process' AND action IN ('create', 'terminate', 'parent_child'))
      OR (kind = 'file' AND action IN ('read', 'write', 'delete', 'encrypt', 'rename'))
      OR (kind = 'network' AND action IN ('dns', 'http', 'https', 'smb', 'c2', 'beaconing', 'upload', 'download'))
      OR (kind = 'auth' AND action IN ('login', 'logout', 'escalate', 'token_abuse')) AS allowed, count(*) AS n
    FROM a GROUP BY ALL
    """,
)
def action_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.expr("CASE event_id % 7 WHEN 0 THEN 'create' WHEN 1 THEN 'READ' WHEN 2 THEN 'login' WHEN 3 THEN 'dns' WHEN 4 THEN 'rename' WHEN 5 THEN 'terminate' ELSE 'fly' END")
    kind = F.when(F.col("event_type") == "authentication", F.lit("auth")).otherwise(F.col("event_type"))
    rows = telemetry(spark, sf_dir).select(kind.alias("kind"), action.alias("action"))
    return rows.withColumn("allowed", filters.allowed_action(F.col("kind"), F.col("action"))).groupBy("kind", "action", "allowed").agg(F.count("*").alias("n"))


@register(
    "command_rules",
    f"""
    WITH {TELEMETRY}, c AS (SELECT CASE event_id % 5 WHEN 0 THEN concat(command, 'SQBFAFgAIAAoAE4AZQB3') WHEN 1 THEN 'CertUtil -decode a b' WHEN 2 THEN 'bitsadmin /transfer job' WHEN 3 THEN 'vssadmin  Delete   shadows /all' ELSE command END AS command FROM telemetry)
    SELECT CASE WHEN regexp_matches(command, '(?i)powershell.*-enc(odedcommand)?\\s+[A-Za-z0-9+/=]{{20,}}') THEN 'encoded_powershell' WHEN regexp_matches(command, '(?i)certutil.*-decode') THEN 'certutil_decode'
      WHEN regexp_matches(command, '(?i)bitsadmin.*/transfer') THEN 'bitsadmin_transfer' WHEN regexp_matches(command, '(?i)vssadmin.*delete\\s+shadows') THEN 'shadow_deletion' ELSE 'none' END AS rule, count(*) AS n FROM c GROUP BY 1
    """,
)
def command_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.expr(
        "CASE event_id % 5 WHEN 0 THEN concat(command, 'SQBFAFgAIAAoAE4AZQB3') WHEN 1 THEN 'CertUtil -decode a b' WHEN 2 THEN 'bitsadmin /transfer job' "
        "WHEN 3 THEN 'vssadmin  Delete   shadows /all' ELSE command END"
    )
    rule = F.coalesce(filters.command_rule(F.col("command")), F.lit("none"))
    return telemetry(spark, sf_dir).withColumn("command", planted).groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


_STAGE_SQL = f"""
    s AS (SELECT src_ip AS source, count(*) AS n_events, min(ts) AS first_seen, max(ts) AS last_seen,
      array_to_string(list_sort(list(DISTINCT event_type)), ',') AS event_types, array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports,
      bool_or(dst_ip <> '') AS has_target, bool_or(source_mode = 'SCENARIO') AS scenario, bool_or({_TOKENS}) AS suspicious,
      bool_or(event_type IN ('network', 'authentication', 'process')) AS common_type, bool_or({_HAS('command', 'lsass', 'mimikatz')}) AS credential_tool,
      bool_or({_HAS('command', 'powershell')} AND {_HAS('command', 'enc')}) AS encoded_shell,
      bool_or(contains(event_type, 'powershell') OR {_HAS('command', 'powershell')}) AS powershell, bool_or(event_type = 'network') AS network,
      bool_or(event_type IN ('network', 'dns') OR {_HAS('command', 'scan', 'ping')}) AS s1, bool_or(event_type IN ('authentication', 'network') OR {_HAS('command', 'ssh', 'rdp')}) AS s2,
      bool_or(event_type IN ('process', 'powershell')) AS s3, bool_or({_HAS('command', 'run', 'schtasks', 'registry')}) AS s4,
      bool_or({_HAS('command', 'whoami', 'net', 'systeminfo')}) AS s5, bool_or({_HAS('command', 'mimikatz', 'lsass', 'pass')}) AS s6, bool_or({_HAS('command', 'c2', 'beacon')}) AS s7,
      bool_or(contains(event_type, 'auth')) AS authentication_observed, bool_or({_HAS('command', 'fail', 'brute')}) AS bruteforce_attempt
      FROM telemetry GROUP BY 1),
    g AS (SELECT *, CASE WHEN s1 OR s2 OR s3 OR s4 OR s5 OR s6 OR s7 THEN list_filter([CASE WHEN s1 THEN 'RECONNAISSANCE' END, CASE WHEN s2 THEN 'INITIAL_ACCESS' END,
      CASE WHEN s3 THEN 'EXECUTION' END, CASE WHEN s4 THEN 'PERSISTENCE' END, CASE WHEN s6 THEN 'CREDENTIAL_ACCESS' END, CASE WHEN s5 THEN 'DISCOVERY' END,
      CASE WHEN s7 THEN 'COMMAND_AND_CONTROL' END], lambda x: x IS NOT NULL) ELSE ['INITIAL_ACCESS'] END AS stages FROM s)
"""


@register(
    "attack_sessions",
    f"""
    WITH {TELEMETRY}, {_STAGE_SQL}
    SELECT source, n_events, first_seen, last_seen, event_types, ports, array_to_string(stages, ',') AS stages, authentication_observed, bruteforce_attempt FROM g
    """,
)
def attack_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.sessions(telemetry(spark, sf_dir))
    joined = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("event_types", "ports", "stages")}
    return s.withColumns(joined).select("source", "n_events", "first_seen", "last_seen", *joined, "authentication_observed", "bruteforce_attempt")


@register(
    "campaigns",
    f"""
    WITH {TELEMETRY}, {_STAGE_SQL},
    c AS (SELECT *, CASE WHEN powershell OR credential_tool OR network OR has_target THEN list_filter([CASE WHEN powershell THEN 'T1059.001' END, CASE WHEN credential_tool THEN 'T1003.001' END,
      CASE WHEN network OR has_target THEN 'T1071.001' END], lambda x: x IS NOT NULL) ELSE ['T1059'] END AS tech FROM g WHERE suspicious OR (n_events >= 2 AND common_type) OR scenario)
    SELECT concat('CMP-', upper(left(sha256(source), 12))) AS campaign_id, source, n_events, first_seen, last_seen, array_to_string(stages, ',') AS stages,
      stages[-1] AS campaign_stage, array_to_string(tech, ',') AS techniques,
      round(greatest(0.40e0, least(0.95e0, 0.5e0 + CASE WHEN n_events >= 5 THEN 0.15e0 WHEN n_events >= 2 THEN 0.1e0 ELSE 0e0 END + CASE WHEN len(tech) >= 2 THEN 0.13e0 ELSE 0e0 END)), 2) AS confidence,
      CASE WHEN list_has_any(stages, ['CREDENTIAL_ACCESS', 'COMMAND_AND_CONTROL']) OR credential_tool THEN 'CRITICAL'
           WHEN list_has_any(stages, ['EXECUTION', 'PERSISTENCE']) OR n_events >= 4 OR encoded_shell THEN 'HIGH' ELSE 'MEDIUM' END AS severity
    FROM c
    """,
)
def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.campaigns(C.sessions(telemetry(spark, sf_dir)))


@register(
    "campaign_stats",
    f"""
    WITH {TELEMETRY}, {_STAGE_SQL}
    SELECT count(*) AS n_campaigns, count(*) FILTER (WHERE list_has_any(stages, ['CREDENTIAL_ACCESS', 'COMMAND_AND_CONTROL']) OR credential_tool) AS critical,
      CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(len(stages)) AS BIGINT) AS n_stages, max(last_seen) AS last_seen
    FROM g WHERE suspicious OR (n_events >= 2 AND common_type) OR scenario
    """,
)
def campaign_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C.campaigns(C.sessions(telemetry(spark, sf_dir)))
    return c.agg(
        F.count("*").alias("n_campaigns"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.sum("n_events").alias("n_events"),
        F.sum(F.size(F.split("stages", ","))).alias("n_stages"),
        F.max("last_seen").alias("last_seen"),
    )


@register(
    "technique_coverage",
    f"""
    WITH {TELEMETRY}, h AS (
      SELECT unnest(list_filter([CASE WHEN {_HAS('command', 'powershell')} THEN 'T1059.001' END, CASE WHEN {_HAS('command', 'mimikatz')} THEN 'T1003.001' END,
        CASE WHEN {_HAS('command', 'sh.bin', 'wget')} THEN 'T1105' END, CASE WHEN {_HAS('command', 'ssh')} THEN 'T1110.001' END], lambda x: x IS NOT NULL)) AS technique FROM telemetry),
    k(technique) AS (VALUES ('T1059.001'), ('T1003.001'), ('T1105'), ('T1110.001'), ('T1486'))
    SELECT k.technique, count(h.technique) AS n, count(h.technique) > 0 AS observed FROM k LEFT JOIN h ON k.technique = h.technique GROUP BY k.technique
    """,
)
def technique_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"T1059.001": ("powershell",), "T1003.001": ("mimikatz",), "T1105": ("sh.bin", "wget"), "T1110.001": ("ssh",), "T1486": ()}
    k = F.col("command")
    wide = telemetry(spark, sf_dir).agg(*[(count_where(text.has(k, *w)) if w else F.lit(0).cast("long")).alias(t) for t, w in rules.items()])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(t).alias("technique"), F.col(f"`{t}`").alias("n")) for t in rules])).alias("r")).select("r.*")
    return long.withColumn("observed", F.col("n") > 0)


@register(
    "attack_story",
    f"""
    WITH {TELEMETRY}, r(step, name) AS (VALUES (0, 'access'), (1, 'execution'), (2, 'download'), (3, 'credentials'), (4, 'control')),
    h AS (SELECT r.step, r.name, t.ts, t.event_id, row_number() OVER (PARTITION BY r.step ORDER BY t.ts, t.event_id) AS rn FROM r JOIN telemetry t ON
      (r.step = 0 AND t.event_type = 'authentication') OR (r.step = 1 AND t.event_type = 'powershell') OR (r.step = 2 AND contains(t.command, 'wget'))
      OR (r.step = 3 AND contains(t.command, 'mimikatz')) OR (r.step = 4 AND contains(t.command, 'beacon')))
    SELECT step, name, ts, event_id FROM h WHERE rn = 1
    """,
)
def attack_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("command"), F.col("event_type")
    steps = {"access": t == "authentication", "execution": t == "powershell", "download": k.contains("wget"), "credentials": k.contains("mimikatz"), "control": k.contains("beacon")}
    return C.story(telemetry(spark, sf_dir), steps, ["ts", "event_id"])


@register(
    "temporal_edges",
    """
    WITH e AS (SELECT user_id, event_id AS src, lead(event_id) OVER w AS dst, event_type AS a, lead(event_type) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS gap
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), f AS (SELECT * FROM e WHERE dst IS NOT NULL)
    SELECT user_id, src, dst, gap AS gap_seconds, CASE WHEN a = b THEN 'continuation' ELSE 'temporal' END AS transition,
      (CASE WHEN gap < 1 THEN 2.0e0 WHEN gap < 60 THEN 1.5e0 WHEN gap < 3600 THEN 1.0e0 ELSE 0.5e0 END) * (CASE WHEN a = b THEN 1.5e0 ELSE 1.0e0 END) AS weight FROM f
    """,
)
def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = windows.consecutive(events, ["user_id"], ["ts", "event_id"], "event_id", "ts", ("event_type",))
    a, b = F.col("src_event_type"), F.col("dst_event_type")
    return edges.select("user_id", "src", "dst", "gap_seconds", windows.transition_type(a, b).alias("transition"), windows.edge_weight(F.col("gap_seconds"), windows.related(a, b)).alias("weight"))


@register(
    "causal_edges",
    f"""
    WITH {TELEMETRY}, e AS (SELECT host, pid, event_id AS src, lead(event_id) OVER (PARTITION BY host, pid ORDER BY ts, event_id) AS dst FROM telemetry WHERE event_type = 'process')
    SELECT host, pid, src, dst, 2.0e0 AS weight FROM e WHERE dst IS NOT NULL
    """,
)
def causal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).filter("event_type = 'process'")
    return windows.consecutive(t, ["host", "pid"], ["ts", "event_id"], "event_id", "ts").select("host", "pid", "src", "dst", F.lit(2.0).alias("weight"))


@register(
    "gap_stats",
    """
    WITH g AS (SELECT user_id, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, abs(gap - lag(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS change FROM g)
    SELECT user_id, count(*) AS n_events, round(avg(gap), 4) AS mean_gap, max(gap) AS max_gap, round(sqrt(var_pop(gap)), 4) AS sd_gap, round(avg(change), 4) AS mean_change,
      count(*) FILTER (WHERE gap < 5) AS bursts, count(*) FILTER (WHERE gap > 300) AS quiet FROM c GROUP BY user_id
    """,
)
def gap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = windows.gap_statistics(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], ["ts", "event_id"], "ts")
    return g.select("user_id", "n_events", F.round("mean_gap", 4).alias("mean_gap"), "max_gap", F.round(F.sqrt("var_gap"), 4).alias("sd_gap"), F.round("mean_change", 4).alias("mean_change"), "bursts", "quiet")


@register(
    "latest_per_user",
    """
    SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3
    """,
)
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "event_type")
    return windows.first_n(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)


@register(
    "dedupe_window",
    """
    WITH RECURSIVE o AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    f AS (SELECT user_id, event_type, ts, rn, ts AS first_ts FROM o WHERE rn = 1
      UNION ALL SELECT o.user_id, o.event_type, o.ts, o.rn, CASE WHEN o.ts >= f.first_ts + INTERVAL 1 HOUR THEN o.ts ELSE f.first_ts END
      FROM f JOIN o ON o.user_id = f.user_id AND o.event_type = f.event_type AND o.rn = f.rn + 1)
    SELECT user_id, event_type, first_ts, count(*) AS repeats FROM f GROUP BY ALL
    """,
)
def dedupe_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return windows.dedupe_within(events, ["user_id", "event_type"], "ts", ["event_id"], 3600)


@register(
    "contradictions",
    """
    WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, count(DISTINCT event_type) > 1 AS contradicting FROM r WHERE rn <= 5 GROUP BY user_id
    """,
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = windows.first_n(events.select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    return last.groupBy("user_id").agg((F.countDistinct("event_type") > 1).alias("contradicting"))


@register(
    "unified_feed",
    f"""
    WITH {TELEMETRY}, u AS (
      SELECT concat('e', event_id % 500) AS id, ts, 'telemetry' AS branch, 0 AS p FROM telemetry WHERE source_mode = 'LIVE'
      UNION ALL SELECT concat('e', event_id % 700), ts, 'alerts', 1 FROM telemetry WHERE source_mode = 'TPOT'
      UNION ALL SELECT concat('c', conv_id), NULL, 'history', 2 FROM conversations)
    SELECT id, ts, branch FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, ts NULLS FIRST) AS rn FROM u) WHERE rn = 1
    """,
)
def unified_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    history = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("c"), F.col("conv_id")).alias("id"))
    branches = {
        "telemetry": t.filter("source_mode = 'LIVE'").select(F.concat(F.lit("e"), F.col("event_id") % 500).alias("id"), "ts"),
        "alerts": t.filter("source_mode = 'TPOT'").select(F.concat(F.lit("e"), F.col("event_id") % 700).alias("id"), "ts"),
        "history": history,
    }
    return sets.feed(branches, "id", "ts").select("id", "ts", "branch")


@register(
    "timeline",
    f"""
    WITH {TELEMETRY}
    SELECT * FROM (
      (SELECT 'event' AS lane, CAST(event_id AS VARCHAR) AS id, ts FROM telemetry ORDER BY ts DESC, event_id LIMIT 20)
      UNION ALL (SELECT 'campaign', src_ip, max(ts) FROM telemetry GROUP BY src_ip ORDER BY max(ts) DESC, src_ip LIMIT 5)
      UNION ALL (SELECT 'response', CAST(event_id AS VARCHAR), ts FROM telemetry WHERE severity = 'CRITICAL' ORDER BY ts DESC, event_id LIMIT 10))
    """,
)
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    event = t.orderBy(F.desc("ts"), "event_id").limit(20).select(F.lit("event").alias("lane"), F.col("event_id").cast("string").alias("id"), "ts")
    grouped = t.groupBy("src_ip").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "src_ip").limit(5)
    campaign = grouped.select(F.lit("campaign").alias("lane"), F.col("src_ip").alias("id"), "ts")
    response = t.filter("severity = 'CRITICAL'").orderBy(F.desc("ts"), "event_id").limit(10).select(F.lit("response").alias("lane"), F.col("event_id").cast("string").alias("id"), "ts")
    return event.unionByName(campaign).unionByName(response)


@register(
    "snapshot_diff",
    """
    WITH a AS (SELECT user_id, max(event_type) AS t, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
    b AS (SELECT user_id, max(event_type) AS t, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'create' WHEN b.user_id IS NULL THEN 'delete' ELSE 'modify' END AS change
    FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.user_id IS NULL OR b.user_id IS NULL OR a.t <> b.t OR a.n <> b.n
    """,
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    state = lambda c: events.filter(c).groupBy("user_id").agg(F.max("event_type").alias("t"), F.count("*").alias("n"))
    return sets.snapshot_diff(state("ts < timestamp_ntz '2024-01-15 00:00:00'"), state("ts >= timestamp_ntz '2024-01-15 00:00:00'"), "user_id", ["t", "n"])


@register(
    "process_edges",
    f"""
    WITH {TELEMETRY}
    SELECT host, pid, pid // 10 AS parent, count(*) AS n FROM telemetry WHERE event_type = 'process' GROUP BY ALL
    """,
)
def process_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir).filter("event_type = 'process'")
    return t.groupBy("host", "pid", F.expr("pid div 10").alias("parent")).agg(F.count("*").alias("n"))


@register(
    "tactic_scores",
    f"""
    WITH {TELEMETRY}
    SELECT host, event_type, count(*) AS n, count(*) * 1.0e0 / sum(count(*)) OVER (PARTITION BY host) AS score FROM telemetry GROUP BY host, event_type
    """,
)
def tactic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = telemetry(spark, sf_dir).groupBy("host", "event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("score", F.col("n") / F.sum("n").over(Window.partitionBy("host")))


@register(
    "event_fingerprints",
    f"""
    WITH {TELEMETRY}
    SELECT event_id, sha256(concat_ws(':', event_type, pid, src_ip, dst_ip, dst_port, command)) AS fingerprint FROM telemetry
    """,
)
def event_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col(c) for c in ("event_type", "pid", "src_ip", "dst_ip", "dst_port", "command")]
    return telemetry(spark, sf_dir).select("event_id", text.event_fingerprint(*parts).alias("fingerprint"))


@register(
    "blast_radius",
    f"""
    WITH {TELEMETRY}
    SELECT host, count(DISTINCT CASE WHEN event_type = 'network' AND dst_ip <> '' THEN dst_ip END) AS n_ips, count(DISTINCT CASE WHEN event_type = 'process' THEN pid END) AS n_pids,
      count(DISTINCT CASE WHEN event_type = 'file' THEN command END) AS n_files FROM telemetry GROUP BY host
    """,
)
def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda t, c: F.countDistinct(F.when((F.col("event_type") == t) & (F.col(c).cast("string") != ""), F.col(c)))
    return telemetry(spark, sf_dir).groupBy("host").agg(kind("network", "dst_ip").alias("n_ips"), kind("process", "pid").alias("n_pids"), kind("file", "command").alias("n_files"))


@register(
    "first_indicator_per_source",
    f"""
    WITH {TELEMETRY}
    SELECT src_ip, event_id, command FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY ts, event_id) AS rn FROM telemetry WHERE source_mode = 'TPOT') WHERE rn = 1
    """,
)
def first_indicator_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).filter("source_mode = 'TPOT'")
    best = rows.groupBy("src_ip").agg(F.min(F.struct("ts", "event_id", "command")).alias("b"))
    return best.select("src_ip", "b.event_id", "b.command")


@register(
    "defence_decisions",
    f"""
    WITH {TELEMETRY}, g AS (SELECT src_ip, max(command) AS command, count(*) AS n FROM telemetry GROUP BY src_ip),
    r AS (SELECT *, CASE WHEN {_HAS('command', 'lsass', 'mimikatz')} THEN 0.95e0 WHEN contains(command, 'powershell') AND {_HAS('command', 'enc', 'download', 'bypass')} THEN 0.88e0
      WHEN n >= 3 THEN 0.65e0 ELSE 0.4e0 END AS risk, CASE WHEN n >= 5 THEN 0.92e0 WHEN n >= 2 THEN 0.78e0 ELSE 0.5e0 END AS confidence FROM g)
    SELECT src_ip, risk, confidence, CASE WHEN confidence >= 0.85 AND risk >= 0.8 THEN 'CONFIRMED' WHEN risk >= 0.65 OR confidence >= 0.7 THEN 'LIKELY' WHEN risk >= 0.35 THEN 'SUSPICIOUS' ELSE 'BENIGN' END AS decision FROM r
    """,
)
def defence_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from duskwatch.functions.scoring import defence_decision

    g = telemetry(spark, sf_dir).groupBy("src_ip").agg(F.max("command").alias("command"), F.count("*").alias("n"))
    d = defence_decision(F.col("command"), F.array().cast("array<string>"), F.col("n"), F.lit(False), F.lit(False))
    return g.select("src_ip", d.alias("d")).select("src_ip", "d.*")
