"""Texts and classes of a verdict: rationale, attack stage, intent, script rules, distances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import entropy, has
from .vectors import mapped_cosine

# Tactics in order, techniques of behaviours, words in campaign ids by class, and stages of tactics.
TACTICS = (
    "reconnaissance", "initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion", "credential_access",
    "discovery", "lateral_movement", "collection", "exfiltration", "impact", "command_and_control",
)
TECHNIQUES = {
    "execution": ["T1059", "T1569", "T1053"], "persistence": ["T1547", "T1053", "T1543"], "privilege_escalation": ["T1055", "T1548", "T1134"],
    "discovery": ["T1083", "T1057", "T1082"], "lateral_movement": ["T1021", "T1570", "T1210"], "collection": ["T1005", "T1074", "T1560"],
    "exfiltration": ["T1041", "T1048", "T1020"], "impact": ["T1486", "T1490", "T1485"], "command_and_control": ["T1071", "T1095", "T1132"],
    "credential_access": ["T1003", "T1555", "T1110"],
}
CAMPAIGN_WORDS = (
    ("APT", ("apt", "advanced", "persistent")), ("Ransomware", ("ransomware", "crypto", "encrypt")), ("Insider_Threat", ("insider", "internal", "employee")),
    ("Malware", ("malware", "trojan", "backdoor")), ("Phishing", ("phish", "email", "social")),
)
MIDDLE_TACTICS = ("execution", "persistence", "privilege_escalation", "discovery")
LATE_TACTICS = ("lateral_movement", "collection", "exfiltration", "impact")
# Patterns of suspicious scripts.
SCRIPT_RULES = (
    r"(?i)Invoke-Expression|iex\s",
    r"(?i)DownloadString|DownloadFile",
    r"(?i)VirtualAlloc|WriteProcessMemory|CreateThread",
    r"(?i)Reflect\.Assembly|System\.Reflection",
    r"(?i)amsiUtils|amsiInitFailed",
)
# A second view of a behaviour vector by (first, end).
VIEW_SLICES = {"structural": (0, 43), "temporal": (43, 68), "semantic": (68, 128)}


def part(v: Column, first: int, end: int) -> Column:
    return F.slice(v, first + 1, end - first)


def component_similarity(a: Column, b: Column, ranges: list[tuple[int, int]], weights: list[float]) -> Column:
    """Weighted mean of the mapped cosines of several ranges of two vectors; weights that don't add up to 1 are an error."""
    if abs(sum(weights) - 1) > 1e-6 or len(weights) != len(ranges):
        raise ValueError("one weight for each range, and 1 in all")
    return reduce(lambda x, y: x + y, [mapped_cosine(part(a, *r), part(b, *r)) * w for r, w in zip(ranges, weights)])


def component_view(a: Column, b: Column, slices: dict[str, tuple[int, int]] = VIEW_SLICES) -> Column:
    """Mapped cosine of each slice and of the whole vectors."""
    return F.struct(*[mapped_cosine(part(a, *r), part(b, *r)).alias(n) for n, r in slices.items()], mapped_cosine(a, b).alias("overall"))


def as_distance(similarity: Column) -> Column:
    return F.lit(1.0) - similarity


def as_similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def campaign_class(campaign_id: Column) -> Column:
    """Class of a campaign by words in its id; Malware if none is there."""
    out = F.lit("Malware")
    for name, words in reversed(CAMPAIGN_WORDS):
        out = F.when(has(campaign_id, *words), F.lit(name)).otherwise(out)
    return out


def attack_stage(tactics: Column, complexity: Column) -> Column:
    """initial, intermediate or advanced from the tactics present and nodes plus edges of the graph; initial without tactics."""
    late = F.size(F.array_intersect(tactics, F.array(*map(F.lit, LATE_TACTICS))))
    middle = F.size(F.array_intersect(tactics, F.array(*map(F.lit, MIDDLE_TACTICS))))
    return (
        F.when(F.coalesce(F.size(tactics), F.lit(0)) <= 0, F.lit("initial"))
        .when((late >= 2) | (complexity > 50), F.lit("advanced"))
        .when((middle >= 2) | (complexity > 20), F.lit("intermediate"))
        .otherwise(F.lit("initial"))
    )


def intents(vector: Column, size: int = 128, most: int = 5) -> Column:
    """The ``most`` tactics with the largest mean size of their ten numbers of the vector; ties in the order of tactics."""
    scored = []
    for i, tactic in enumerate(TACTICS):
        first = i * 10 % size
        numbers = F.transform(part(vector, first, min(first + 10, size)), F.abs)
        mean = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc + x) / F.size(numbers)
        scored.append(F.struct((-mean).alias("order"), F.lit(i).alias("at"), F.lit(tactic).alias("tactic"), mean.alias("score")))
    return F.transform(F.slice(F.array_sort(F.array(*scored)), 1, most), lambda s: F.struct(s["tactic"].alias("tactic"), s["score"].alias("score")))


def extremes(vector: Column, novelty: Column, limit: float = 0.8, most: int = 5) -> Column:
    """The first dimensions whose size exceeds ``limit``, for novelty above it; else none."""
    numbered = F.transform(vector, lambda x, i: F.struct(i.alias("dim"), F.abs(x).alias("size")))
    return F.when(novelty > 0.8, F.slice(F.filter(numbered, lambda s: s["size"] > limit), 1, most)).otherwise(F.array().cast("array<struct<dim: int, size: double>>"))


def techniques_of(behaviour: Column) -> Column:
    """Techniques of a behaviour, none for unknown ones."""
    table = F.create_map(*[x for k, v in TECHNIQUES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, behaviour), F.array().cast("array<string>"))


def techniques_in_order(behaviours: Column) -> Column:
    """Techniques of several behaviours, each once, in order of first mention."""
    return F.array_distinct(F.flatten(F.transform(behaviours, techniques_of)))


def script_verdict(script: Column) -> Column:
    """(matched, score, threat) of a script by rules and entropy; null and empty scripts score 0.1."""
    text = F.coalesce(script, F.lit(""))
    n = reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in SCRIPT_RULES])
    bad = (n >= 2) | ((n >= 1) & (entropy(text) > 5.8))
    return F.struct(
        n.alias("matched"), F.when(bad, F.lit(0.88)).when(n == 1, F.lit(0.45)).otherwise(F.lit(0.10)).alias("score"),
        F.when(bad, F.lit("Heuristic.ObfuscatedScript")).when(n == 1, F.lit("Heuristic.SuspiciousCmdlet")).alias("threat"),
    )


def rationale(threat: Column, novelty: Column, lateral: Column, exfiltration: Column, confidence: Column) -> Column:
    """One sentence with the factors of a risk."""
    factors = F.array_compact(F.array(
        F.when(threat.isin("APT", "Ransomware"), F.concat(F.lit("High-severity threat class ("), threat, F.lit(")"))),
        F.when(novelty > 0.8, F.lit("Potential zero-day attack (highly novel behavior)")).when(novelty > 0.5, F.lit("Variant attack behavior (moderately novel)")),
        F.when(lateral, F.lit("Lateral movement detected")),
        F.when(exfiltration, F.lit("Data exfiltration detected")),
        F.when(confidence < 0.5, F.format_string("Low confidence (%.2f) reduces reliability", confidence)),
    ))
    plain = F.concat(F.lit("Standard risk assessment for "), threat, F.lit(" threat"))
    return F.when(F.size(factors) > 0, F.concat(F.lit("Risk assessment based on: "), F.array_join(factors, "; "))).otherwise(plain)


def risk_trend(current: Column, residual: Column) -> Column:
    """(delta, trend) of the risk before and after what was done."""
    return F.struct(F.round(current - residual, 2).alias("risk_delta"), F.when(residual < current, F.lit("DECREASING")).otherwise(F.lit("STABLE")).alias("risk_trend"))


def has_file_indicator(metadata: Column, features: Column) -> Column:
    """True if the metadata name a hash or a feature has the length of one."""
    named = F.coalesce(F.map_contains_key(metadata, "hash") | F.map_contains_key(metadata, "sha256"), F.lit(False))
    return named | F.coalesce(F.exists(features, lambda f: F.length(f) == 64), F.lit(False))
