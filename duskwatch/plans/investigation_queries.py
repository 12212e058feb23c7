"""Queries of investigations: chains, evidence, what speaks for a class, and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import vectors as V
from duskwatch.operators import campaigns as C
from duskwatch.operators import investigations as I

from .registry import register
from .telemetry import TELEMETRY, telemetry
from .telemetry_queries import _STAGE_SQL
from .vector_queries import _E

# The tables' vectors have 64 places, so their parts are half as long.
DIMENSIONS_64 = {"structural": (0, 22), "temporal": (22, 34), "semantic": (34, 64)}

_COMMAND = "concat(command, CASE WHEN event_id % 17 = 0 THEN ' -EncodedCommand' ELSE '' END, CASE WHEN event_id % 19 = 0 THEN ' VSSadmin' ELSE '' END)"
_PROCESS = "CASE WHEN event_id % 7 = 0 THEN 'Explorer.exe' ELSE split_part(command, ' ', 1) END"
_HAS_ANY = lambda c, *words: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"
_SIGNS = ", ".join(
    f"({first}, {weight}, '{title}', '{tid}', '{name}', '{tactic}')" for first, weight, title, _, tid, name, tactic in I.SIGNS
) + f", ({I.CLEAN[0]}, {I.CLEAN[1]}, '{I.CLEAN[2]}', NULL, NULL, NULL), ({I.SOCKET[0]}, {I.SOCKET[1]}, '{I.SOCKET[2]}', '{I.SOCKET[3]}', '{I.SOCKET[4]}', '{I.SOCKET[5]}')"
_CHAIN = f"""
    {TELEMETRY}, r AS (SELECT host, event_id, ts, event_type, {_PROCESS} AS process_name, pid, {_COMMAND} AS command, dst_ip, dst_port,
        row_number() OVER (PARTITION BY host ORDER BY ts NULLS FIRST, event_id) AS position FROM telemetry),
    chain AS (SELECT *, CASE event_type WHEN 'process' THEN 'proc' WHEN 'network' THEN 'net' END AS kind,
        CASE event_type WHEN 'process' THEN process_name WHEN 'network' THEN concat('Socket ', dst_ip) END AS title,
        CASE event_type WHEN 'process' THEN concat('PID: ', pid) WHEN 'network' THEN concat('Port ', dst_port) END AS subtitle FROM r),
    signs(first, weight, sign, technique_id, technique_name, tactic) AS (VALUES {_SIGNS}),
    ev AS (SELECT host, position, title AS record, subtitle AS detail, concat('EV-', first + position) AS evidence_id, weight, sign, technique_id, technique_name, tactic FROM chain, signs
        WHERE CASE first {" ".join(f"WHEN {s[0]} THEN kind = 'proc' AND {_HAS_ANY('command', *s[3])}" for s in I.SIGNS)}
            WHEN {I.CLEAN[0]} THEN kind = 'proc' AND {_HAS_ANY('process_name', *I.CLEAN[3])}
            ELSE kind = 'net' AND dst_ip <> '' AND {" AND ".join(f"NOT starts_with(dst_ip, '{p}')" for p in I.INTERNAL)} END)
"""


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir).select("host", "event_id", "ts", "event_type", F.expr(_PROCESS).alias("process_name"), "pid", F.expr(_COMMAND).alias("command"), "dst_ip", "dst_port")
    return I.chain(rows, "host", ["ts", "event_id"])


@register("investigation_chain", f"WITH {_CHAIN} SELECT host, event_id, position, kind, title, subtitle FROM chain")
def investigation_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host's events in order with what the chain shows of them."""
    return _chained(spark, sf_dir).select("host", "event_id", "position", "kind", "title", "subtitle")


@register("investigation_evidence", f"WITH {_CHAIN} SELECT * FROM ev")
def investigation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs for and against in every host's events."""
    return I.evidence(_chained(spark, sf_dir), "host")


@register(
    "investigation_summary",
    f"""
    WITH {_CHAIN}, c AS (SELECT host, count(*) AS n_events, count(kind) AS n_chain, min(ts) AS start_time, max(ts) AS end_time FROM chain GROUP BY host),
    s AS (SELECT host, count(*) FILTER (WHERE weight > 0) AS n_supporting, count(*) FILTER (WHERE weight < 0) AS n_contradicting, CAST(sum(weight) FILTER (WHERE weight > 0) AS BIGINT) AS sw,
        CAST(-sum(weight) FILTER (WHERE weight < 0) AS BIGINT) AS cw, array_to_string(list_sort(list(DISTINCT technique_id) FILTER (WHERE technique_id IS NOT NULL)), ',') AS techniques FROM ev GROUP BY host)
    SELECT host, n_events, n_chain, start_time, end_time, coalesce(n_supporting, 0) AS n_supporting, coalesce(n_contradicting, 0) AS n_contradicting, coalesce(sw, 0) AS supporting_weight,
      coalesce(cw, 0) AS contradicting_weight, coalesce(techniques, '') AS techniques, concat('Ingested and correlated ', n_events, ' telemetry events from real host.') AS what_happened,
      concat('Analyzed ', coalesce(n_supporting, 0), ' supporting malicious signals vs ', coalesce(n_contradicting, 0), ' benign baseline signals.') AS why_suspicious,
      concat('Correlated ', n_chain, ' execution chain nodes.') AS evidence_summary
    FROM c LEFT JOIN s USING (host)
    """,
)
def investigation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a host."""
    chained = _chained(spark, sf_dir)
    return I.investigations(chained, I.evidence(chained, "host"), "host").withColumn("techniques", F.array_join("techniques", ","))


# Vectors stretched by their id, so that every rule holds for some; classes, novelty and counts by id as well.
_CLASSES = "CASE vec_id % 5 WHEN 0 THEN 'APT' WHEN 1 THEN 'Ransomware' WHEN 2 THEN 'Insider_Threat' WHEN 3 THEN 'Malware' ELSE 'Benign' END"
_FACTS = f"""
    {_E}, x AS (SELECT vec_id, list_transform(v, lambda y: y * (2 + vec_id % 7)) AS v, {_CLASSES} AS threat_class, (vec_id % 11) / 10e0 AS novelty, vec_id % 90 AS n FROM e),
    m AS (SELECT *, list_avg(list_transform(v[35:64], lambda y: abs(y))) AS mean, list_var_pop(v[1:22]) AS spread, list_max(list_transform(v[23:34], lambda y: abs(y))) AS peak FROM x),
    f AS (SELECT vec_id, threat_class, novelty, unnest([
        {{'place': 0, 'name': 'lateral_movement', 'a': CASE WHEN n > 50 THEN least(1e0, n / 100e0) END}}, {{'place': 1, 'name': 'persistence_mechanism', 'a': CASE WHEN mean > 0.6 THEN least(1e0, mean) END}},
        {{'place': 2, 'name': 'credential_access', 'a': CASE WHEN mean > 0.6 THEN least(1e0, mean * 0.8e0) END}}, {{'place': 3, 'name': 'defense_evasion', 'a': CASE WHEN spread > 0.1 THEN least(1e0, spread * 2) END}},
        {{'place': 4, 'name': 'process_injection', 'a': CASE WHEN spread > 0.1 THEN least(1e0, spread * 1.5e0) END}}, {{'place': 5, 'name': 'reconnaissance', 'a': CASE WHEN peak > 0.7 THEN least(1e0, peak * 0.9e0) END}},
        {{'place': 6, 'name': 'execution_anomaly', 'a': CASE WHEN peak > 0.7 THEN least(1e0, peak * 0.7e0) END}}]) AS s FROM m),
    base(name, dimension, w) AS (VALUES {", ".join(f"('{n}', '{d}', {w}e0)" for n, (d, w) in I.FEATURES.items())}),
    aff(threat_class, name, k) AS (VALUES {", ".join(f"('{c}', '{n}', {k}e0)" for c, t in I.AFFINITY.items() for n, k in t.items())}),
    known AS (SELECT vec_id, s.place AS place, s.name AS name, dimension, least(1e0, greatest(0.05e0, w * s.a * coalesce(k, 1e0) * CASE WHEN novelty > 0.7e0 THEN 1 + novelty * 0.3e0 ELSE 1e0 END)) AS weight
        FROM f JOIN base ON base.name = s.name LEFT JOIN aff ON aff.name = s.name AND aff.threat_class = f.threat_class WHERE s.a IS NOT NULL),
    fill(place, name, weight) AS (VALUES {", ".join(f"({i}, '{n}', {w}e0)" for i, (n, w) in enumerate(I.FILLERS.items()))}),
    n AS (SELECT x.vec_id, count(known.name) AS n FROM x LEFT JOIN known USING (vec_id) GROUP BY 1),
    every AS (SELECT vec_id, place, array_to_string(list_transform(string_split(name, '_'), lambda t: concat(upper(t[1]), t[2:])), ' ') AS name, dimension, weight FROM known
        UNION ALL SELECT vec_id, 7 + place, name, 'semantic', weight FROM n, fill WHERE place < 5 - n),
    top AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY round(weight, 12) DESC, place)::INTEGER AS rank, name, dimension, weight FROM every QUALIFY rank <= 5)
"""


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform(V.doubles(F.col("embedding")), lambda y: y * (2 + F.col("vec_id") % 7)).alias("v"))
    rows = rows.select("vec_id", *[c.alias(name) for name, c in I.signals(F.col("v"), DIMENSIONS_64).items()])
    shown = I.shown_by({name: F.col(name) for name in ("mean", "spread", "peak")}, {"all": F.col("vec_id") % 90})
    return rows.select("vec_id", I.contributions(shown, F.expr(_CLASSES), (F.col("vec_id") % 11) / 10).alias("top"))


@register("feature_contributions", f"WITH {_FACTS} SELECT vec_id, rank, name, dimension, round(weight, 9) AS weight FROM top")
def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five features that weigh most for each vector."""
    # every vector has features or fillers; without outer, Spark would put a filter on them below and work all out again
    rows = _contributions(spark, sf_dir).select("vec_id", F.posexplode_outer("top").alias("i", "r"))
    return rows.select("vec_id", (F.col("i") + 1).alias("rank"), "r.name", "r.dimension", F.round("r.weight", 9).alias("weight"))


@register(
    "contribution_dimensions",
    f"""
    WITH {_FACTS}, d(dimension) AS (VALUES ('structural'), ('temporal'), ('semantic'))
    SELECT ids.vec_id, d.dimension, count(t.name)::INTEGER AS n_features, coalesce(string_agg(t.name, '; ' ORDER BY t.rank), '') AS names
    FROM (SELECT DISTINCT vec_id FROM top) ids CROSS JOIN d LEFT JOIN top t ON t.vec_id = ids.vec_id AND t.dimension = d.dimension GROUP BY ALL
    """,
)
def contribution_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part of the vector each of the five features belongs to; names only, as engines round the shown weights differently."""
    rows = _contributions(spark, sf_dir).select("vec_id", F.explode_outer(I.by_dimension(F.col("top"))).alias("dimension", "found"))
    return rows.select("vec_id", "dimension", F.size("found").alias("n_features"), F.array_join(F.transform("found", lambda t: F.split_part(t, F.lit(" (Weight"), F.lit(1))), "; ").alias("names"))


@register(
    "largest_activations",
    f"""
    WITH {_E}, x AS (SELECT vec_id, unnest(range(64)) AS i, abs(unnest(v)) AS weight FROM e)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, i DESC)::INTEGER AS rank, concat('embedding_dim_', i) AS name, round(weight, 9) AS weight FROM x QUALIFY rank <= 5
    """,
)
def largest_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest places of each vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(I.top_activations(V.doubles(F.col("embedding")))).alias("i", "r"))
    return rows.select("vec_id", (F.col("i") + 1).alias("rank"), "r.name", F.round("r.weight", 9).alias("weight"))


@register(
    "importance_activations",
    f"""
    WITH {_E}, x AS (SELECT vec_id, unnest(range(64)) AS place, unnest(v) AS y FROM e), k AS (SELECT place, round(var_pop(y), 9) AS importance FROM x GROUP BY place),
    t AS (SELECT *, row_number() OVER (ORDER BY importance DESC, place)::INTEGER AS rank FROM k QUALIFY rank <= 5)
    SELECT vec_id, rank, concat('feature_', place) AS name, round(importance * abs(y), 9) AS weight FROM x JOIN t USING (place)
    """,
)
def importance_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that vary most over all vectors as the important ones, times each vector's value there."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    importance = rows.select(F.posexplode("v").alias("place", "y")).groupBy("place").agg(F.round(F.var_pop("y"), 9).alias("importance"))
    return I.top_by_importance(rows, "vec_id", "v", importance).withColumn("weight", F.round("weight", 9))


_CAMPAIGN = """
    c AS (SELECT source, n_events, last_seen, source_mode, CASE WHEN list_has_any(stages, ['CREDENTIAL_ACCESS', 'COMMAND_AND_CONTROL']) OR credential_tool THEN 'CRITICAL'
        WHEN list_has_any(stages, ['EXECUTION', 'PERSISTENCE']) OR n_events >= 4 OR encoded_shell THEN 'HIGH' ELSE 'MEDIUM' END AS severity
      FROM g WHERE suspicious OR (n_events >= 2 AND common_type) OR scenario)
"""


def _campaigns_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry(spark, sf_dir)
    return C.campaigns(C.sessions(rows.withColumn("src_ip", F.concat_ws("@", "src_ip", "source_mode")))).withColumn("source_mode", F.split_part("source", F.lit("@"), F.lit(2)))


@register(
    "engine_status",
    f"""
    WITH {TELEMETRY.replace('telemetry AS', 'raw AS', 1)}, telemetry AS (SELECT * REPLACE (concat(src_ip, '@', source_mode) AS src_ip) FROM raw), {_STAGE_SQL},
    {_CAMPAIGN.replace('source_mode,', "split_part(source, '@', 2) AS source_mode,")},
    a AS (SELECT source_mode, count(*) AS events_analyzed, max(ts) AS last_event FROM telemetry GROUP BY 1),
    b AS (SELECT source_mode, count(*) AS active_campaigns, CAST(sum(n_events) AS BIGINT) AS events_correlated, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high_risk_campaigns FROM c GROUP BY 1)
    SELECT source_mode, events_analyzed, last_event, coalesce(active_campaigns, 0) AS active_campaigns, coalesce(events_correlated, 0) AS events_correlated,
      coalesce(high_risk_campaigns, 0) AS high_risk_campaigns, 'CONNECTED' AS status
    FROM a LEFT JOIN b USING (source_mode)
    """,
)
def engine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the campaign engine has seen of each kind of source."""
    return I.engine_status(telemetry(spark, sf_dir), _campaigns_by_mode(spark, sf_dir))


@register(
    "recommendation_summary",
    """
    SELECT p_brand AS profile, count(*) AS total, count(*) FILTER (WHERE p_size % 5 + 1 <= 2) AS high_priority, count(*) FILTER (WHERE p_partkey % 3 = 0) AS automation_available,
      round(avg((p_size % 10) / 10e0), 3) AS average_effectiveness, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS categories
    FROM part GROUP BY 1
    """,
)
def recommendation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as recommendations for their brand."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_brand").alias("profile"), (F.col("p_size") % 5 + 1).alias("priority"), (F.col("p_partkey") % 3 == 0).alias("automated"), ((F.col("p_size") % 10) / 10.0).alias("effectiveness"), F.col("p_type").alias("category")
    )
    return I.recommendation_summary(rows, "profile").withColumn("categories", F.array_join("categories", ","))


def _confidence(n: Column) -> Column:
    return (n % 10) / 10.0


@register(
    "risk_matrix",
    """
    SELECT o_orderkey, CASE WHEN (o_orderkey % 13) / 12e0 >= 0.7 THEN 'HIGH_RISK' ELSE 'LOW_RISK' END || '_' || CASE WHEN (o_orderkey % 10) / 10e0 >= 0.7 THEN 'HIGH_CONF' ELSE 'LOW_CONF' END AS quadrant
    FROM orders
    """,
)
def risk_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as campaigns in the plane of risk and confidence."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", I.risk_quadrant((k % 13) / 12.0, _confidence(k)).alias("quadrant"))


@register(
    "security_narrative",
    f"""
    WITH {TELEMETRY}, {_STAGE_SQL}, {_CAMPAIGN.replace('source_mode,', '')},
    o AS (SELECT count(*) AS n_events, count(DISTINCT split_part(command, ' ', 1)) AS n_processes, count(*) FILTER (WHERE dst_ip <> '') AS n_sockets FROM telemetry),
    k AS (SELECT count(*) AS n_campaigns, max(CASE severity WHEN 'CRITICAL' THEN 0.9e0 WHEN 'HIGH' THEN 0.7e0 ELSE 0.4e0 END) AS peak, max(CASE severity WHEN 'CRITICAL' THEN 0e0 WHEN 'HIGH' THEN 0.7e0 ELSE 0.4e0 END) AS residual FROM c)
    SELECT printf('During the selected 24h window, %d events were analyzed across endpoint assets. Observed %d unique processes and %d network sockets, correlating into %d active threat campaigns with peak threat risk %.2f and residual risk %.2f.',
      n_events, n_processes, n_sockets, n_campaigns, peak, residual) AS narrative FROM o, k
    """,
)
def security_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole telemetry in a sentence; critical campaigns count as handled."""
    t = telemetry(spark, sf_dir)
    overview = t.agg(F.count("*").alias("n_events"), F.countDistinct(F.split_part("command", F.lit(" "), F.lit(1))).alias("n_processes"), F.count_if(F.col("dst_ip") != "").alias("n_sockets"))
    risk = F.when(F.col("severity") == "CRITICAL", 0.9).when(F.col("severity") == "HIGH", 0.7).otherwise(0.4)
    found = C.campaigns(C.sessions(t)).agg(F.count("*").alias("n_campaigns"), F.max(risk).alias("peak_risk"), F.max(F.when(F.col("severity") == "CRITICAL", 0.0).otherwise(risk)).alias("residual_risk"))
    return I.narrative(overview.crossJoin(F.broadcast(found)), "24h").select("narrative")


@register(
    "evidence_records",
    """
    WITH a AS (SELECT DISTINCT CAST(o_orderkey * 7 AS VARCHAR) AS id FROM orders)
    SELECT a.id, CASE WHEN e.event_id IS NOT NULL THEN 'event' WHEN p.p_partkey IS NOT NULL THEN 'campaign' END AS origin, coalesce(e.event_type, p.p_name) AS says
    FROM a LEFT JOIN events e ON CAST(e.event_id AS VARCHAR) = a.id LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = a.id
    """,
)
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids looked up among events, then among parts as campaigns."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    asked = read("orders").select((F.col("o_orderkey") * 7).cast("string").alias("id"))
    found = I.by_id(asked, "id", ("event", read("events").withColumnRenamed("event_id", "id")), ("campaign", read("part").withColumnRenamed("p_partkey", "id")))
    return found.select("id", "origin", F.coalesce(F.get_json_object("record", "$.event_type"), F.get_json_object("record", "$.p_name")).alias("says"))
