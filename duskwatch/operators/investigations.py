"""Investigations: the numbered chain of a profile's events, evidence for and against, what speaks for a class, and roll-ups.

Chains and evidence are rows, so a profile may have any number of events; only counts and the few known techniques are
gathered for each profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import vectors as V
from duskwatch.functions.text import has

from .numbering import numbered

# Kinds of events, and the addresses that count as internal.
PROCESS_KINDS, NETWORK_KINDS = ("process", "proc"), ("net", "network")
INTERNAL = ("127.", "10.", "192.168.", "172.16.")
# Number range, weight, title, words of the command, technique id, name and tactic of each sign.
SIGNS = (
    (1000, 25, "+ Encoded/Obfuscated Command Execution", ("-encodedcommand", "base64", "-bypass"), "T1059.001", "Command and Scripting Interpreter", "Execution"),
    (2000, 30, "+ Process Memory Dump (LSASS Read)", ("lsass", "sekurlsa", "mimikatz"), "T1003.001", "LSASS Memory Dump", "Credential Access"),
    (3000, 30, "+ Volume Shadow Copy Erasure", ("vssadmin", "delete shadows"), "T1490", "Inhibit System Recovery", "Impact"),
)
CLEAN = (4000, -15, "- Valid Digital Signature / Standard Binary", ("chrome.exe", "explorer.exe", "svchost.exe", "lsass.exe"))
SOCKET = (5000, 25, "+ Outbound External Network Socket", "T1071.001", "Web Protocols", "Command & Control")
# Parts of a vector, features with their part and base weight, what a class adds, and fillers.
DIMENSIONS = {"structural": (0, 43), "temporal": (43, 68), "semantic": (68, 128)}
FEATURES = {
    "privilege_escalation": ("semantic", 0.35), "network_beacon": ("temporal", 0.28), "lateral_movement": ("structural", 0.25), "data_exfiltration": ("semantic", 0.32),
    "persistence_mechanism": ("semantic", 0.30), "credential_access": ("semantic", 0.27), "defense_evasion": ("structural", 0.24), "reconnaissance": ("temporal", 0.20),
    "initial_access": ("structural", 0.26), "execution_anomaly": ("temporal", 0.23), "file_encryption": ("semantic", 0.38), "process_injection": ("structural", 0.29),
    "network_discovery": ("temporal", 0.21), "command_control": ("temporal", 0.31), "impact_behavior": ("semantic", 0.36),
}
AFFINITY = {
    "APT": {"lateral_movement": 1.5, "persistence_mechanism": 1.4, "credential_access": 1.3, "reconnaissance": 1.2},
    "Ransomware": {"file_encryption": 1.8, "privilege_escalation": 1.4, "defense_evasion": 1.3, "impact_behavior": 1.6},
    "Insider_Threat": {"data_exfiltration": 1.6, "credential_access": 1.4, "privilege_escalation": 1.3},
    "Malware": {"process_injection": 1.4, "persistence_mechanism": 1.3, "defense_evasion": 1.2},
}
#: Rows of a table that one task sorts, about.
ROWS_A_PART = 500_000
FILLERS = {"Anomalous Behavior": 0.15, "System Interaction": 0.12, "Process Activity": 0.10, "Network Communication": 0.08, "File Operations": 0.06}


def chain(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Events of each profile with ``position`` from 1 and, for processes and sockets, ``kind``, ``title`` and ``subtitle``.

    ``events`` has event_type, process_name, pid, command, dst_ip and dst_port. Other kinds of events keep their place in the
    numbering with a null kind; a title or subtitle whose value is missing is null.
    """
    kind = F.when(F.col("event_type").isin(*PROCESS_KINDS), "proc").when(F.col("event_type").isin(*NETWORK_KINDS), "net")
    title = F.when(kind == "proc", F.col("process_name")).when(kind == "net", F.concat(F.lit("Socket "), F.col("dst_ip")))
    subtitle = F.when(kind == "proc", F.concat(F.lit("PID: "), F.col("pid"))).when(kind == "net", F.concat(F.lit("Port "), F.col("dst_port")))
    return numbered(events, order, [key], "position").withColumns({"kind": kind, "title": title, "subtitle": subtitle})


def evidence(chained: DataFrame, key: str) -> DataFrame:
    """One row for each sign of an event of ``chain``: its id, the event's place, weight, title and technique (null against)."""
    at = F.col("position")

    def sign(cond: Column, first: int, weight: int, title: str, technique: tuple[str | None, ...]) -> Column:
        names = ("technique_id", "technique_name", "tactic")
        known = [F.lit(t).cast("string").alias(n) for n, t in zip(names, technique)]
        return F.when(cond, F.struct(F.concat(F.lit("EV-"), at + first).alias("evidence_id"), F.lit(weight).alias("weight"), F.lit(title).alias("sign"), *known))

    process, socket = F.col("kind") == "proc", F.col("kind") == "net"
    found = [sign(process & has(F.col("command"), *words), first, weight, title, about) for first, weight, title, words, *about in SIGNS]
    first, weight, title, words = CLEAN
    found.append(sign(process & has(F.col("process_name"), *words), first, weight, title, (None, None, None)))
    first, weight, title, *about = SOCKET
    outside = F.col("dst_ip") != ""
    for prefix in INTERNAL:
        outside = outside & ~F.startswith("dst_ip", F.lit(prefix))
    found.append(sign(socket & outside, first, weight, title, tuple(about)))
    rows = chained.select(key, "position", "title", "subtitle", F.explode(F.array_compact(F.array(*found))).alias("e"))
    return rows.select(key, "position", F.col("title").alias("record"), F.col("subtitle").alias("detail"), "e.*")


def investigations(chained: DataFrame, signs: DataFrame, key: str) -> DataFrame:
    """One row a profile: events, chain length, evidence and weight each way, techniques, and the sentences on them."""
    events = chained.groupBy(key).agg(F.count("*").alias("n_events"), F.count("kind").alias("n_chain"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    support, against = F.col("weight") > 0, F.col("weight") < 0
    found = signs.groupBy(key).agg(
        F.count_if(support).alias("n_supporting"), F.count_if(against).alias("n_contradicting"),
        F.sum(F.when(support, F.col("weight"))).alias("supporting_weight"), F.sum(F.when(against, -F.col("weight"))).alias("contradicting_weight"),
        F.array_sort(F.collect_set("technique_id")).alias("techniques"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_supporting", "n_contradicting", "supporting_weight", "contradicting_weight")}
    rows = events.join(found, key, "left").withColumns(zero | {"techniques": F.coalesce("techniques", F.array().cast("array<string>"))})
    return rows.withColumns({
        "what_happened": F.format_string("Ingested and correlated %d telemetry events from real host.", "n_events"),
        "why_suspicious": F.format_string("Analyzed %d supporting malicious signals vs %d benign baseline signals.", "n_supporting", "n_contradicting"),
        "evidence_summary": F.format_string("Correlated %d execution chain nodes.", "n_chain"),
    })


def signals(vector: Column, dimensions: dict[str, tuple[int, int]] | None = None) -> dict[str, Column]:
    """What the parts of a vector say: their mean size, their spread and their peak."""
    part = {name: V.part(vector, (ends,)) for name, ends in (dimensions or DIMENSIONS).items()}
    return {"mean": V.mean_abs(part["semantic"]), "spread": V.variance(part["structural"]), "peak": F.array_max(F.transform(part["temporal"], F.abs))}


def activations(vector: Column, dimensions: dict[str, tuple[int, int]] | None = None, counts: dict[str, Column] | None = None) -> dict[str, Column]:
    """How strongly each feature shows, null where it doesn't: from the vector's parts and, if given, counts of graph nodes
    (keys ``process``, ``network``, ``file`` and ``all``)."""
    return shown_by(signals(vector, dimensions), counts)


def shown_by(said: dict[str, Column], counts: dict[str, Column] | None = None) -> dict[str, Column]:
    """``activations`` from ``signals``, which it refers to several times: over many rows they should be columns."""
    mean, spread, peak = said["mean"], said["spread"], said["peak"]
    when = lambda cond, x: F.when(cond, F.least(F.lit(1.0), x))
    out: dict[str, Column] = {}
    for name, (what, above, whole) in {
        "privilege_escalation": ("process", 5, 20.0), "network_beacon": ("network", 3, 15.0), "command_control": ("network", 3, 12.0), "data_exfiltration": ("file", 8, 25.0),
        "file_encryption": ("file", 8, 20.0), "lateral_movement": ("all", 50, 100.0),
    }.items():
        if counts and what in counts:
            out[name] = when(counts[what] > above, counts[what] / whole)
    return out | {
        "persistence_mechanism": when(mean > 0.6, mean), "credential_access": when(mean > 0.6, mean * 0.8), "defense_evasion": when(spread > 0.1, spread * 2.0),
        "process_injection": when(spread > 0.1, spread * 1.5), "reconnaissance": when(peak > 0.7, peak * 0.9), "execution_anomaly": when(peak > 0.7, peak * 0.7),
    }


def contributions(found: dict[str, Column], threat_class: Column, novelty: Column, most: int = 5) -> Column:
    """The strongest features as an array of (name, weight, dimension), fillers up to ``most``; ties keep the order of the features.

    A weight is base x activation x affinity of the class, more for novelty above 0.7, within 0.05 and 1. Fillers count as
    semantic. Weights are compared on 12 decimals.
    """
    factor = F.when(novelty > 0.7, 1.0 + novelty * 0.3).otherwise(1.0)
    rows = []
    for place, (name, shown) in enumerate(found.items()):
        dimension, base = FEATURES[name]
        affinity = F.lit(1.0)
        for kind, extra in AFFINITY.items():
            if name in extra:
                affinity = F.when(threat_class == kind, extra[name]).otherwise(affinity)
        weight = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.lit(base) * shown * affinity * factor))
        rows.append(F.struct(F.when(shown.isNotNull(), weight).alias("weight"), F.lit(place).alias("place"), F.lit(name.replace("_", " ").title()).alias("name"), F.lit(dimension).alias("dimension")))
    known = F.transform(F.filter(F.array(*rows), lambda r: r["weight"].isNotNull()), lambda r: _feature(r["weight"], r["place"], r["name"], r["dimension"]))
    fill = F.array(*[_feature(F.lit(w), F.lit(len(found) + i), F.lit(name), F.lit("semantic")) for i, (name, w) in enumerate(FILLERS.items())])
    every = V.bound(known, lambda k: F.concat(k, F.slice(fill, F.lit(1), F.greatest(F.lit(0), F.lit(most) - F.size(k)))))
    return F.transform(F.slice(F.sort_array(every), 1, most), lambda r: F.struct(r["name"].alias("name"), r["weight"].alias("weight"), r["dimension"].alias("dimension")))


def _feature(weight: Column, place: Column, name: Column, dimension: Column) -> Column:
    return F.struct((-F.round(weight, 12)).alias("rank"), place.alias("place"), name.alias("name"), weight.alias("weight"), dimension.alias("dimension"))


def by_dimension(found: Column) -> Column:
    """Contributions as a map from each part of the vector to its features with weights."""
    text = lambda r: F.format_string("%s (Weight: %.2f)", r["name"], r["weight"])
    of = lambda d: F.transform(F.filter(found, lambda r: r["dimension"] == d), text)
    return F.create_map(*[x for d in DIMENSIONS for x in (F.lit(d), of(d))])


def top_activations(vector: Column, most: int = 5) -> Column:
    """Without a trained model: the places with the largest absolute values, (name, weight); of equal ones the later first."""
    rows = F.transform(vector, lambda x, i: F.struct(F.abs(x).alias("weight"), i.alias("place")))
    best = F.slice(F.reverse(F.array_sort(rows)), 1, most)
    return F.transform(best, lambda r: F.struct(F.concat(F.lit("embedding_dim_"), r["place"]).alias("name"), r["weight"].alias("weight")))


def top_by_importance(rows: DataFrame, key: str, vector: str, importance: DataFrame, most: int = 5) -> DataFrame:
    """(key, rank, name, weight): the model's most important places, each times the row's absolute value there.

    ``importance`` has place and importance; of equal ones the lower place first. Only ``most`` rows of it are broadcast. Places
    beyond a vector's end are left out.
    """
    best = importance.orderBy(F.desc("importance"), "place").limit(most)
    ranked = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("negative"), "place"))).alias("best"))
    parts = rows.select(key, F.col(vector).alias("v")).crossJoin(F.broadcast(ranked)).select(key, "v", F.posexplode("best").alias("i", "b"))
    return parts.filter(F.col("b.place") < F.size("v")).select(
        key, (F.col("i") + 1).alias("rank"), F.concat(F.lit("feature_"), F.col("b.place")).alias("name"), (-F.col("b.negative") * F.abs(F.get("v", F.col("b.place")))).alias("weight")
    )


def narrative(metrics: DataFrame, window: str) -> DataFrame:
    """The overview of a window as one sentence each; ``metrics`` has the numbers that it names."""
    text = F.format_string(
        f"During the selected {window} window, %d events were analyzed across endpoint assets. Observed %d unique processes and %d network sockets, "
        "correlating into %d active threat campaigns with peak threat risk %.2f and residual risk %.2f.",
        "n_events", "n_processes", "n_sockets", "n_campaigns", "peak_risk", "residual_risk",
    )
    return metrics.withColumn("narrative", text)


def risk_quadrant(risk: Column, confidence: Column, high: float = 0.7) -> Column:
    """Which quarter of the risk and confidence plane a campaign lies in; null if either is unknown."""
    name = F.concat(F.when(risk >= high, "HIGH_RISK").when(risk < high, "LOW_RISK"), F.lit("_"), F.when(confidence >= high, "HIGH_CONF").when(confidence < high, "LOW_CONF"))
    return name


def recommendation_summary(recommendations: DataFrame, key: str) -> DataFrame:
    """One row a profile: how many recommendations, urgent ones (priority 1 or 2), automated ones, their categories and mean effect."""
    return recommendations.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(F.col("priority") <= 2).alias("high_priority"), F.count_if(F.col("automated")).alias("automation_available"),
        F.round(F.avg("effectiveness"), 3).alias("average_effectiveness"), F.array_sort(F.collect_set("category")).alias("categories"),
    )


def engine_status(events: DataFrame, campaigns: DataFrame, by: str = "source_mode") -> DataFrame:
    """One row for each kind of source: its events, sessions with their events, campaigns, critical ones, and the newest time.

    ``campaigns`` has ``by``, source, n_events and severity, and one row for each session; a kind with events is CONNECTED.
    """
    seen = events.groupBy(by).agg(F.count("*").alias("events_analyzed"), F.max("ts").alias("last_event"))
    found = campaigns.groupBy(by).agg(
        F.count("*").alias("active_campaigns"), F.sum("n_events").alias("events_correlated"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_risk_campaigns")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("events_analyzed", "active_campaigns", "events_correlated", "high_risk_campaigns")}
    out = seen.join(found, by, "full").withColumns(zero)
    return out.withColumn("status", F.when(F.col("events_analyzed") > 0, "CONNECTED").otherwise("NO_INPUT"))


def by_id(asked: DataFrame, key: str, *tables: tuple[str, DataFrame]) -> DataFrame:
    """The record of each asked id as JSON, from the first of the (name, rows) tables that has it; ids in none have null.

    Every table has ``key``, cast to text. Rows of a table that share an id are all returned. Ids and tables are dealt out by id to
    as many parts as their rows ask for, so that what a task sorts doesn't grow with them.
    """
    spark = asked.sparkSession
    most = max(asked.count(), *[rows.count() for _, rows in tables])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-most // ROWS_A_PART))
    out = asked.select(F.col(key).cast("string").alias(key)).repartition(parts, key).distinct()
    none = F.lit(None).cast("string")
    origin, record, missing = none, none, F.lit(True)
    for i, (name, rows) in enumerate(tables):
        at, held = f"__id{i}", f"__row{i}"
        known = rows.select(F.col(key).cast("string").alias(at), F.struct("*").alias(held)).filter(F.col(at).isNotNull()).repartition(parts, at)
        out = out.join(known, (F.col(key) == F.col(at)) & missing, "left")
        origin, record = F.coalesce(origin, F.when(F.col(held).isNotNull(), name)), F.coalesce(record, F.to_json(held))
        missing = missing & F.col(held).isNull()
    return out.select(key, origin.alias("origin"), record.alias("record"))
