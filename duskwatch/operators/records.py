"""Stored records: campaign searches, decoded profiles, event records, bulk appends with triggers, watch list, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.text import nonempty

from . import sinks
from .filters import both
from .knowledge import pattern_error

# Names of programs and remote ports that a scan reports.
SUSPICIOUS_NAMES = ("mimikatz.exe", "nc.exe", "psexec.exe", "pwdump.exe")
REMOTE_PORTS = (4444, 1337, 6667, 8888, 9001)
# Fields of a record of each type; those after the bar only if they are there.
EVENT_FIELDS = {
    "process": "pid action | name command_line parent_pid", "file": "path action | file_size hash",
    "network": "action | source_ip dest_ip source_port dest_port protocol domain", "auth": "user action | success source_ip",
}
# When upkeep is due.
MOST_PATTERNS, MOST_VERSIONS, GROWTH, DROP = 10_000, 10, 100, 0.05


def search_campaigns(campaigns: DataFrame, mode: str, status: str | None = None, severity: str | None = None, analyst_status: str | None = None, text: str | None = None) -> DataFrame:
    """Campaigns of a source mode, newest first. The text is looked for, in any case, in id, name, techniques and source addresses."""
    equal = {"status": status, "severity": severity, "analyst_status": analyst_status}
    conds = [F.upper("source_mode") == mode.upper(), *[F.col(c) == v for c, v in equal.items() if v]]
    if text:
        texts = F.concat_ws("\n", "campaign_id", "campaign_name", F.array_join("technique_ids", "\n"), F.array_join("source_ips", "\n"))
        conds.append(F.contains(F.lower(texts), F.lit(text.lower())))
    return campaigns.filter(both(*conds)).orderBy(F.desc_nulls_last("last_seen"), "campaign_id")


def profile(history: DataFrame, profile_id: str) -> DataFrame:
    """Rows of a profile with their three JSON texts decoded: two maps and a list of maps; a text that is no JSON gives null."""
    rows = history.filter(F.col("profile_id") == profile_id)
    return rows.select(
        "profile_id", F.from_json("profile_json", "map<string,string>").alias("profile"), F.from_json("device_metadata", "map<string,string>").alias("device_metadata"),
        F.from_json("events", "array<map<string,string>>").alias("events"),
    )


def event_record(kind: str, event_id: Column, ts: Column, values: dict[str, Column], source: Column | None = None) -> Column:
    """A record of an event type: its data hold the type's fields, those that may be missing only if they are neither null, "" nor 0.

    ``success`` counts as there unless it is null. Other ``values`` are kept too. A missing source is "unknown".
    """
    if kind not in EVENT_FIELDS:
        raise ValueError(f"unknown event type {kind!r}; known are {', '.join(EVENT_FIELDS)}")
    needed, optional = (part.split() for part in EVENT_FIELDS[kind].split("|"))
    if missing := [n for n in needed if n not in values]:
        raise ValueError(f"{kind} needs {', '.join(missing)}")
    text = {n: c.cast("string") for n, c in values.items()}
    there = lambda n, c: c.isNotNull() if n == "success" else c.isNotNull() & ~c.isin("", "0")
    pairs = [F.when(there(n, c) if n in optional else F.lit(True), F.struct(F.lit(n).alias("key"), c.alias("value"))) for n, c in text.items()]
    return F.struct(
        event_id.alias("event_id"), F.lit(kind).alias("event_type"), ts.alias("timestamp"), F.coalesce(source if source is not None else F.lit(None).cast("string"), F.lit("unknown")).alias("source_system"),
        F.map_from_entries(F.array_compact(F.array(*pairs))).alias("event_data"),
    )


def scan_findings(processes: DataFrame, connections: DataFrame) -> DataFrame:
    """(finding, subject, n) for programs with a known bad name and remote ports that control servers use."""
    name, port = F.lower("name"), F.col("remote_port")
    bad = processes.filter(name.isin(*SUSPICIOUS_NAMES)).groupBy(F.lit("process").alias("finding"), name.alias("subject")).agg(F.count("*").alias("n"))
    return bad.unionByName(connections.filter(port.isin(*REMOTE_PORTS)).groupBy(F.lit("connection").alias("finding"), port.cast("string").alias("subject")).agg(F.count("*").alias("n")))


def bulk_append(patterns: DataFrame, log: str, before: int, accuracy: float | None = None, baseline: float | None = None, size: int = 128) -> DataFrame:
    """Append valid patterns to the log; one row: added, refused, growth since ``before``, triggers that fire, whether to retrain.

    Patterns have pattern_id and embedding. Growth counts different ids.
    """
    spark = patterns.sparkSession
    checked = patterns.withColumn("__error", pattern_error(F.col("embedding"), size))
    sinks.append(checked.filter("__error is null").drop("__error"), log)
    counts = checked.agg(F.count_if(F.col("__error").isNull()).alias("added"), F.count("__error").alias("refused"))
    known = spark.read.parquet(log).agg((F.countDistinct("pattern_id") - before).alias("growth"))
    fell = F.lit(accuracy is not None and baseline is not None and baseline - accuracy > DROP)
    triggers = F.array_compact(F.array(F.when(F.col("growth") >= GROWTH, "kb_growth"), F.when(fell, "performance_degradation")))
    return counts.crossJoin(F.broadcast(known)).withColumn("triggers", triggers).withColumn("retrain", F.size("triggers") > 0)


def watch(addresses: DataFrame, path: str) -> None:
    """Append (value, reason) entries to the watch list; empty values are left out."""
    sinks.append(addresses.select(nonempty(F.trim("value")).alias("value"), "reason").filter("value is not null"), path)


def watched(spark: SparkSession, path: str) -> DataFrame:
    """The watch list: each value once, with its latest reason and how often it was put there."""
    return spark.read.parquet(path).groupBy("value").agg(F.max_by("reason", F.struct("logged_at", "reason")).alias("reason"), F.count("*").alias("entries"))


def playbooks(events: DataFrame, by: str = "source_mode") -> DataFrame:
    """Recommended playbooks of each kind of source with the events that call for them; scenarios get both in any case."""
    shell = F.contains(F.lower(F.coalesce("command", F.lit(""))), F.lit("powershell")) | F.contains(F.lower(F.coalesce("event_type", F.lit(""))), F.lit("powershell"))
    socket = (F.col("event_type") == "network") | (F.coalesce("dst_ip", F.lit("")) != "")
    counts = events.groupBy(by).agg(F.count_if(shell).alias("shell"), F.count_if(socket).alias("socket"))
    rows = counts.select(by, F.explode(F.array(F.struct(F.lit("Suspicious PowerShell Containment").alias("playbook"), F.col("shell").alias("events")), F.struct(F.lit("SSH Brute Force & Outbound IP Containment").alias("playbook"), F.col("socket").alias("events")))).alias("p"))
    return rows.select(by, "p.*").filter((F.col("events") > 0) | (F.col(by) == "SCENARIO"))


def upkeep(patterns: DataFrame, versions: DataFrame, feedback: DataFrame, as_of: Column, patterns_before: int, days: int = 7) -> DataFrame:
    """One row on the state of knowledge: patterns, versions, the active one, recent feedback, growth, and what is due.

    ``versions`` has version and activated_at; the one activated last is active. ``as_of`` may use columns of ``feedback``.
    """
    p = patterns.agg(F.count("*").alias("patterns"))
    v = versions.agg(F.count("*").alias("versions"), F.max_by("version", F.struct("activated_at", "version")).alias("active_version"))
    f = feedback.agg(F.count_if(F.col("ts") > as_of - F.make_dt_interval(F.lit(days))).alias("recent_feedback"))
    row = p.crossJoin(F.broadcast(v)).crossJoin(F.broadcast(f)).withColumn("growth", F.col("patterns") - patterns_before)
    due = F.array_compact(F.array(
        F.when(F.col("patterns") > MOST_PATTERNS, "apply retention"), F.when(F.col("versions") > MOST_VERSIONS, "clean up versions"), F.when(F.col("growth") >= GROWTH, "retrain"),
    ))
    return row.withColumn("due", due)
