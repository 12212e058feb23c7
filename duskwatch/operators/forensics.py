"""Forensics: what proves a finding from event to response, timelines, latencies, relationships and ancestry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.vectors import cosine, jaccard

from .numbering import numbered
from .steps import stored
from .windows import first_n

# Stages that prove a chain, states of a response that count, longest latency in seconds.
STAGES = ("TELEMETRY_INGESTION", "BEHAVIORAL_DNA_ANALYSIS", "CAMPAIGN_ATTRIBUTION", "DEFENSIVE_ACTION")
DONE, LONGEST = ("VERIFIED", "COMPLETED"), 86_400
# Prefix of a node, its kind and the label of its edge, for each list of a campaign.
RELATIONS = {
    "source_ips": ("ip-", "ip", "OBSERVED_IN"), "destination_ips": ("dst-", "ip", "CONNECTED_TO"), "hosts": ("host-", "host", "TARGETED"), "technique_ids": ("tech-", "technique", "EXECUTED"),
}
# Parts of a pattern that are compared for equality, how they are called, and what agreement adds in percent.
AGREEMENTS = (
    ("process_ancestry", "Process Ancestry Lineage", 35), ("command_flags", "Command Line Arguments", 25),
    ("network_destination", "Network Destination Socket", 20), ("file_activity", "Filesystem Modification Pattern", 20),
)


def evidence_chains(roots: DataFrame, events: DataFrame, patterns: DataFrame, campaigns: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summaries, stages) of the chains that start from or hold each ``root`` id.

    ``events`` has event_id, correlation_id, ts; ``patterns`` pattern_id, fingerprint, related_investigation_id,
    related_threat_id; ``campaigns`` campaign_id, evidence_event_ids; ``actions`` audit_id, evidence_event_ids, all ids as text.
    A root is looked up in every stage, lists by exact id. Then stages without a hit are filled: events from what campaign and
    actions refer to, campaign and actions from the events. Of several patterns or campaigns the lowest id counts, of campaigns
    found through events that of the earliest event. ``stages`` has (root, stage, record); a chain is proven if it has events, a
    campaign and an action; a root without any record has INSUFFICIENT_DATA. Null roots are left out.
    """
    roots = stored(roots.select("root").filter("root is not null").distinct(), "roots")
    held = stored(campaigns.select("campaign_id", F.explode("evidence_event_ids").alias("event_id")).distinct(), "held")
    used = stored(actions.select("audit_id", F.explode("evidence_event_ids").alias("event_id")).distinct(), "used")
    at = lambda df, column, *keep: roots.join(df, F.col("root") == F.col(column)).select("root", *keep)
    several = lambda *parts: reduce(DataFrame.unionByName, parts).distinct()

    # keys of one stage are put together before the join: Spark fails on a union of two joins by root when it splits a skewed one
    by_key = events.select("event_id", "ts", F.explode(F.array("event_id", "correlation_id")).alias("__key"))
    direct = at(by_key, "__key", "event_id", "ts").distinct()
    keys = ("pattern_id", "fingerprint", "related_investigation_id", "related_threat_id")
    named = patterns.select("pattern_id", F.explode(F.array_distinct(F.array(*keys))).alias("__key"))
    pattern = at(named, "__key", "pattern_id").groupBy("root").agg(F.min("pattern_id").alias("pattern_id"))
    both = lambda df, parts, c: df.select(F.col(c).alias("__key"), c).unionByName(parts.select(F.col("event_id").alias("__key"), c))
    own = stored(at(both(campaigns, held, "campaign_id"), "__key", "campaign_id").groupBy("root").agg(F.min("campaign_id").alias("campaign_id")), "campaigns")
    taken = stored(at(both(actions, used, "audit_id"), "__key", "audit_id").distinct(), "actions")

    referred = several(own.join(held, "campaign_id").select("root", "event_id"), taken.join(used, "audit_id").select("root", "event_id"))
    referred = referred.join(direct.select("root").distinct(), "root", "left_anti").join(events.select("event_id", "ts"), "event_id")
    seen = stored(several(direct, referred.select("root", "event_id", "ts")), "events")
    lacking = seen.join(own, "root", "left_anti").join(held, "event_id").groupBy("root").agg(F.min(F.struct("ts", "event_id", "campaign_id"))["campaign_id"].alias("campaign_id"))
    campaign = own.unionByName(lacking)
    more = seen.join(taken.select("root").distinct(), "root", "left_anti").join(used, "event_id").select("root", "audit_id").distinct()
    action = taken.unionByName(more)

    parts = ((seen, "event_id"), (pattern, "pattern_id"), (campaign, "campaign_id"), (action, "audit_id"))
    stages = stored(reduce(DataFrame.unionByName, [df.select("root", F.lit(s).alias("stage"), F.col(c).alias("record")) for s, (df, c) in zip(STAGES, parts)]), "stages")
    n = [F.count_if(F.col("stage") == s).alias(c) for s, c in zip(STAGES, ("n_events", "n_patterns", "n_campaigns", "n_actions"))]
    counts = roots.join(stages.groupBy("root").agg(*n), "root", "left").na.fill(0)
    every, whole = F.col("n_events") + F.col("n_patterns") + F.col("n_campaigns") + F.col("n_actions"), (F.col("n_events") > 0) & (F.col("n_campaigns") > 0) & (F.col("n_actions") > 0)
    status = F.when(every == 0, "INSUFFICIENT_DATA").when(whole, "PROVEN_CHAIN").otherwise("PARTIAL_CHAIN")
    completed = F.when(F.col("n_events") > 0, 1).otherwise(0) + F.col("n_patterns") + F.col("n_campaigns") + F.col("n_actions")
    return counts.withColumns({"stages_completed": completed, "status": status}), stages


def timeline(campaigns: DataFrame, events: DataFrame, key: str, ids: str, event_key: str) -> DataFrame:
    """Events that each campaign lists, with ``position`` from 0 as in the list; ids without an event are left out."""
    asked = campaigns.select(key, F.posexplode(ids).alias("position", "__id"))
    return asked.join(events, F.col("__id") == F.col(event_key)).drop("__id")


def response_latencies(actions: DataFrame, events: DataFrame) -> DataFrame:
    """Seconds, to two places, from the first event that a finished action names to the action, else its own duration.

    ``actions`` has execution_status, ts, evidence_event_ids and duration_seconds, ``events`` event_id and ts. A latency of at
    most 0 or above a day is no latency; actions with neither are left out.
    """
    first = events.select(F.col("event_id").alias("__id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("__at"))
    rows = actions.filter(F.col("execution_status").isin(*DONE)).withColumn("__first", F.get("evidence_event_ids", F.lit(0)))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("__at")) / 1e6
    own = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds"))
    out = rows.join(first, F.col("__first") == F.col("__id"), "left").withColumn("latency", F.round(F.coalesce(F.when((gap > 0) & (gap <= LONGEST), gap), own), 2))
    return out.filter("latency is not null").drop("__first", "__id", "__at")


def detection_latencies(campaigns: DataFrame) -> DataFrame:
    """Seconds from a campaign's first sight to its creation, or its last sight; those within a day."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = (micros(F.coalesce("created_at", "last_seen")) - micros(F.col("first_seen"))) / 1e6
    return campaigns.withColumn("latency", gap).filter(F.col("latency").between(0, LONGEST))


def latency_statistics(rows: DataFrame, value: str = "latency") -> DataFrame:
    """One row: sample size, mean, and the values at the places n/2, 9n/10 and 19n/20 (from 0, rounded down) of the sorted ones."""
    ranked = numbered(rows.select(value), [value], name="__place")
    n = rows.agg(F.count(value).alias("sample_size"), F.round(F.avg(value), 2).alias("mean"))
    size = F.col("sample_size")
    at = lambda part, whole: F.max(F.when(F.col("__place") == F.least(F.expr(f"sample_size * {part} div {whole}"), size - 1) + 1, F.round(value, 2)))
    found = ranked.crossJoin(F.broadcast(n)).agg(at(1, 2).alias("p50"), at(9, 10).alias("p90"), at(19, 20).alias("p95"))
    out = n.crossJoin(F.broadcast(found)).na.fill(0.0, ["mean", "p50", "p90", "p95"])
    return out.withColumn("status", F.when(size > 0, "CALCULATED").otherwise("INSUFFICIENT_DATA"))


def relationships(campaigns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around each campaign: one node for it and one for each different value of its lists."""
    lists = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("edge"), F.transform(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), lambda x: F.struct(x.alias("label"))).alias("found"), F.lit(prefix).alias("prefix"))
        for c, (prefix, kind, label) in RELATIONS.items()
    ])
    rows = campaigns.select("campaign_id", F.explode(lists).alias("r")).select("campaign_id", "r.kind", "r.edge", "r.prefix", F.explode("r.found").alias("f")).filter("f.label is not null")
    rows = rows.select("campaign_id", F.concat("prefix", "f.label").alias("node"), F.col("f.label").alias("label"), "kind", "edge")
    centre = campaigns.select("campaign_id", F.col("campaign_id").alias("node"), F.col("campaign_id").alias("label"), F.lit("campaign").alias("kind"))
    return centre.unionByName(rows.drop("edge")), rows.select("campaign_id", F.col("campaign_id").alias("source"), F.col("node").alias("target"), F.col("edge").alias("label"))


def critical_path(events: DataFrame, key: str, severe: Column, order: list[str], least: int = 3, most: int = 10) -> DataFrame:
    """The first ``most`` severe events of each key in order, with ``step`` from 1; keys with fewer than ``least`` have none."""
    rows = events.filter(severe)
    top = first_n(rows, [key], [F.col(c) for c in order], most).withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    enough = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return top.join(enough, F.col(key).eqNullSafe(F.col("__key")), "left_semi")


def opening_path(events: DataFrame, key: str, severe: Column, order: list[str], opening: int = 3, most: int = 10) -> DataFrame:
    """Of each key the first ``opening`` events in order and the severe ones after them, ``most`` in all; ``order`` names one event."""
    by = [F.col(c) for c in order]
    both = first_n(events, [key], by, opening).unionByName(first_n(events.filter(severe), [key], by, most))
    return first_n(both.dropDuplicates([key, *order]), [key], by, most)


def descendants(edges: DataFrame, most_levels: int = 1000) -> DataFrame:
    """(ancestor, descendants, depth) of a forest of (node, parent) edges, a level at a time; every level is stored once.

    A level holds one count for each ancestor, the sum of those of its children one level up, and no descendant itself.
    Rows with a null end are left out. More than ``most_levels`` levels are an error, as a cycle would never end.
    """
    edges = stored(edges.select("node", "parent").filter("node is not null and parent is not null").distinct(), "parents")
    level, levels = stored(edges.groupBy(F.col("parent").alias("ancestor")).agg(F.count("*").alias("n")), "level-1"), []
    while not level.isEmpty():
        levels.append(level.withColumn("depth", F.lit(len(levels) + 1)))
        if len(levels) > most_levels:
            raise ValueError(f"more than {most_levels} levels, or a cycle")
        up = level.withColumnRenamed("ancestor", "node").join(edges, "node").groupBy(F.col("parent").alias("ancestor")).agg(F.sum("n").alias("n"))
        level = stored(up, f"level-{len(levels) + 1}")
    found = reduce(DataFrame.unionByName, levels, edges.limit(0).select(F.col("parent").alias("ancestor"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("depth")))
    return found.groupBy("ancestor").agg(F.sum("n").alias("descendants"), F.max("depth").alias("depth"))


def pattern_similarity(vector_a: Column, vector_b: Column, steps_a: Column, steps_b: Column) -> Column:
    """Cosine in percent, to one place, if both vectors are there and equally long, else shared steps over all steps."""
    alike = (F.size(vector_a) > 0) & (F.size(vector_a) == F.size(vector_b))
    none = F.array().cast("array<string>")
    shared = jaccard(F.coalesce(steps_a, none), F.coalesce(steps_b, none))
    return F.round(100 * F.when(F.coalesce(alike, F.lit(False)), cosine(vector_a, vector_b)).otherwise(shared), 1)


def agreements(a: Column, b: Column) -> Column:
    """The four compared parts of two patterns as an array of (feature, contribution in percent, match); empty or null parts never match."""
    out = []
    for part, name, percent in AGREEMENTS:
        match = F.coalesce((a[part] == b[part]) & (a[part] != ""), F.lit(False))
        out.append(F.struct(F.lit(name).alias("feature"), F.when(match, percent).otherwise(0).alias("contribution"), match.alias("match")))
    return F.array(*out)


def with_intelligence(sessions: DataFrame) -> DataFrame:
    """Attack sessions with a verdict and advice by their severity and source."""
    bad = F.col("severity").isin("HIGH", "CRITICAL")
    verdict = F.struct(
        F.lit("AbuseIPDB / Honeypot Telemetry").alias("source"), F.when(bad, 88).otherwise(40).alias("reputation_score"), F.when(bad, "Active Threat Actor").otherwise("Suspicious Scanner").alias("verdict")
    )
    advice = F.array(F.concat(F.lit("Recommend blocking source IP "), "src_ip", F.lit(" on Perimeter Firewall")), F.lit("Add IP to Watchlist in Behavioral Knowledge Base"))
    return sessions.withColumns({"threat_intelligence": verdict, "recommendations": advice})


def alert_feed(alerts: DataFrame) -> DataFrame:
    """Stored honeypot alerts as a feed: mode by the id, sensor in capitals, severity by the port."""
    live = F.startswith(F.col("id").cast("string"), F.lit("tpot-live-"))
    return alerts.select(
        F.col("id").alias("event_id"), F.col("timestamp"), F.when(live, "LIVE").otherwise("SCENARIO").alias("source_mode"), F.lit("tpot").alias("sensor"), F.upper("type").alias("honeypot"), "src_ip", "src_port",
        F.col("dest_port").alias("dst_port"), "payload", F.when(F.col("dest_port").isin(22, 445), "HIGH").otherwise("MEDIUM").alias("severity"), F.coalesce("status", F.lit("pending_approval")).alias("status"),
    )
