"""Sessions and campaigns: correlation of events by their source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import has, has_token, nonempty

# Lifecycle stages in order, words that make a campaign, techniques.
STAGES = ("RECONNAISSANCE", "INITIAL_ACCESS", "EXECUTION", "PERSISTENCE", "CREDENTIAL_ACCESS", "DISCOVERY", "COMMAND_AND_CONTROL")
SUSPICIOUS = ["powershell", "wget", "curl", "mimikatz", "lsass", "schtasks", "nc", "chmod", "brute", "bypass"]


def stage_rules(kind: Column, command: Column) -> dict[str, Column]:
    t = F.lower(kind)
    return {
        "RECONNAISSANCE": t.isin("network", "dns") | has(command, "scan", "ping"),
        "INITIAL_ACCESS": t.isin("authentication", "network") | has(command, "ssh", "rdp"),
        "EXECUTION": t.isin("process", "powershell"),
        "PERSISTENCE": has(command, "run", "schtasks", "registry"),
        "CREDENTIAL_ACCESS": has(command, "mimikatz", "lsass", "pass"),
        "DISCOVERY": has(command, "whoami", "net", "systeminfo"),
        "COMMAND_AND_CONTROL": has(command, "c2", "beacon"),
    }


def sessions(events: DataFrame, mode: str | None = None) -> DataFrame:
    """One row per source: what its events show, in one partial aggregation that keeps no event."""
    rows = events if mode is None else events.filter(F.col("source_mode") == mode)
    t, k = F.lower("event_type"), F.col("command")
    rules = stage_rules(F.col("event_type"), k)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    grouped = rows.withColumn("source", nonempty(F.col("src_ip"), F.lit("internal_host"))).groupBy("source").agg(
        F.count("*").alias("n_events"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
        F.array_sort(F.collect_set("dst_port")).alias("ports"),
        F.countDistinct("src_ip").alias("n_sources"),
        flag(nonempty(F.col("dst_ip")).isNotNull()).alias("has_target"),
        flag(F.col("source_mode") == "SCENARIO").alias("scenario"),
        flag(has_token(k, SUSPICIOUS)).alias("suspicious"),
        flag(t.isin("network", "authentication", "process")).alias("common_type"),
        flag(has(k, "lsass", "mimikatz")).alias("credential_tool"),
        flag(has(k, "powershell") & has(k, "enc")).alias("encoded_shell"),
        flag(t.contains("powershell") | has(k, "powershell")).alias("powershell"),
        flag(t == "network").alias("network"),
        flag(t.contains("auth")).alias("authentication_observed"),
        flag(has(k, "fail", "brute")).alias("bruteforce_attempt"),
        flag(has(k, "success", "login")).alias("login_success"),
        flag(t.isin("process", "powershell") & has(k, "wget", "curl", "download", "http")).alias("payload_retrieval"),
        flag(has(k, "whoami", "net user", "ipconfig")).alias("recon_command"),
        *[flag(c).alias(f"stage_{n}") for n, c in rules.items()],
    )
    found = F.array_compact(F.array(*[F.when(F.col(f"stage_{n}"), F.lit(n)) for n in STAGES]))
    stages = F.when(F.size(found) == 0, F.array(F.lit("INITIAL_ACCESS"))).otherwise(found)
    return grouped.withColumn("stages", stages).drop(*[f"stage_{n}" for n in STAGES])


def techniques() -> Column:
    named = F.array_compact(
        F.array(
            F.when(F.col("powershell"), F.lit("T1059.001")),
            F.when(F.col("credential_tool"), F.lit("T1003.001")),
            F.when(F.col("network") | F.col("has_target"), F.lit("T1071.001")),
        )
    )
    return F.when(F.size(named) == 0, F.array(F.lit("T1059"))).otherwise(named)


def campaigns(found: DataFrame) -> DataFrame:
    """Sessions that count as campaigns, with techniques, confidence, severity and a stable id."""
    kept = found.filter(F.col("suspicious") | ((F.col("n_events") >= 2) & F.col("common_type")) | F.col("scenario"))
    n, stages = F.col("n_events"), F.col("stages")
    kept = kept.withColumn("techniques", techniques())
    more = F.when(n >= 5, 0.15).when(n >= 2, 0.10).otherwise(0.0)
    confidence = 0.50 + more + F.when(F.col("n_sources") >= 2, 0.12).otherwise(0.0) + F.when(F.size("techniques") >= 2, 0.13).otherwise(0.0)
    any_of = lambda *s: F.arrays_overlap(stages, F.array(*map(F.lit, s)))
    severity = (
        F.when(any_of("CREDENTIAL_ACCESS", "COMMAND_AND_CONTROL") | F.col("credential_tool"), "CRITICAL")
        .when(any_of("EXECUTION", "PERSISTENCE") | (n >= 4) | F.col("encoded_shell"), "HIGH")
        .otherwise("MEDIUM")
    )
    return kept.select(
        F.concat(F.lit("CMP-"), F.upper(F.substring(F.sha2("source", 256), 1, 12))).alias("campaign_id"),
        "source",
        "n_events",
        "first_seen",
        "last_seen",
        F.array_join("stages", ",").alias("stages"),
        F.element_at(stages, -1).alias("campaign_stage"),
        F.array_join("techniques", ",").alias("techniques"),
        F.round(F.greatest(F.lit(0.40), F.least(F.lit(0.95), confidence)), 2).alias("confidence"),
        severity.alias("severity"),
    )


def story(events: DataFrame, steps: dict[str, Column], order: list[str]) -> DataFrame:
    """First event that satisfies each predicate: one row per step, null where none does."""
    first = lambda c: F.min(F.when(c, F.struct(*order)))
    wide = events.agg(*[first(c).alias(n) for n, c in steps.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(n).alias("first")) for i, n in enumerate(steps)])).alias("s")).select(
        "s.step", "s.name", *[F.col(f"s.first.{o}").alias(o) for o in order]
    )


def threat_class(kind: Column, command: Column, dst_private: Column, action: Column) -> Column:
    """Class of an event by the first rule that holds, null if none does."""
    rules = (
        ("Execution", has(command, "powershell", "bash", "cmd.exe") | has(kind, "powershell")),
        ("Credential Access", has(command, "mimikatz", "lsass", "login") | has(action, "auth_fail")),
        ("Command & Control", ~dst_private | has(command, "c2")),
        ("Discovery / Reconnaissance", has(command, "whoami", "netstat", "ipconfig") | has(action, "scan")),
        ("Malware / File Modification", has(kind, "file") | has(command, "sh.bin") | has(action, "write")),
        ("Defense Evasion", has(command, "enc", "bypass")),
    )
    return reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0])))
