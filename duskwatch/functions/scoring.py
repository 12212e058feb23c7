"""Confidence, novelty and risk as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring model.
CLASS_SEVERITY = {"APT": 1.2, "Ransomware": 1.2, "Insider_Threat": 1.1, "Malware": 1.0, "Phishing": 0.9, "Benign": 0.3}
RISK_LEVELS = ((0.85, "CRITICAL"), (0.70, "HIGH"), (0.50, "MEDIUM"), (0.30, "LOW"))
NOVELTY_LEVELS = ((0.80, "high"), (0.50, "medium"))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ladder(x: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    out = F.when(x >= steps[0][0], F.lit(steps[0][1]))
    for least, name in steps[1:]:
        out = out.when(x >= least, F.lit(name))
    return out.otherwise(F.lit(last))


def raw_score(similarity: Column, novelty: Column) -> Column:
    return clip(0.6 * similarity + 0.4 * (1 - novelty))


def platt(x: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * x + F.lit(b)))


def conservative(r: Column) -> Column:
    """Uncalibrated map: low scores are halved, high scores grow half as fast."""
    return F.when(r < 0.3, 0.5 * r).when(r > 0.7, 0.5 + 0.5 * (r - 0.7)).otherwise(r)


def kb_penalty(patterns: Column) -> Column:
    k = patterns.cast("double")
    return F.when(k >= 50, F.lit(1.0)).when(k == 0, F.lit(0.3)).otherwise(F.greatest(k / 50, F.lit(0.3)))


def confidence(similarity: Column, novelty: Column, matches: Column, patterns: Column, quality: Column) -> Column:
    """Confidence in 0..1 from similarity, novelty, campaign matches, number of known patterns and evidence quality."""
    base = conservative(raw_score(similarity, novelty))
    tense = base * (1 - 0.4 * novelty * (1 - similarity))
    boosted = F.when(matches > 0, tense + (1 - tense) * 0.2 * (1 - F.exp(-0.06 * matches))).otherwise(tense)
    scored = clip(boosted * kb_penalty(patterns) * quality)
    return F.when(patterns < 5, F.greatest(scored, F.lit(0.5))).otherwise(scored)


def interval_half_width(uncertainty: Column, confidence_: Column, patterns: Column, quality: Column, novelty: Column) -> Column:
    few = F.when(patterns < 10, F.lit(2.0)).when(patterns < 50, F.lit(1.5)).otherwise(F.lit(1.0))
    edge = F.when((confidence_ < 0.2) | (confidence_ > 0.8), F.lit(1.3)).otherwise(F.lit(1.0))
    poor = F.when(quality < 0.5, F.lit(1.2)).otherwise(F.lit(1.0))
    new = F.when(novelty > 0.7, F.lit(1.3)).otherwise(F.lit(1.0))
    return 0.5 * uncertainty * few * edge * poor * new


def distance_novelty(last: Column, mean: Column) -> Column:
    return F.least(F.lit(1.0), 0.6 * last + 0.4 * mean)


def novelty(distance: Column, lof: Column) -> Column:
    """Novelty in 0..1 from a distance and a local outlier factor."""
    factor = F.when(lof > 1, F.least((lof - 1) / 2, F.lit(1.0))).otherwise(F.lit(0.0))
    parts = [distance, factor, F.least(1.2 * distance, F.lit(1.0)), 0.8 * distance, 0.9 * factor]
    square = sum((p * p for p in parts), F.lit(0.0)) / len(parts)
    weighted = sum((w * p for w, p in zip((0.3, 0.25, 0.2, 0.15, 0.1), parts, strict=True)), F.lit(0.0))
    return clip(0.6 * F.sqrt(square) + 0.4 * weighted)


def novelty_category(score: Column) -> Column:
    return ladder(score, NOVELTY_LEVELS, "low")


def risk(similarity: Column, novelty_: Column, confidence_: Column, threat: Column, lateral: Column, exfiltration: Column) -> Column:
    """Risk in 0..1; benign findings are capped, lateral movement and exfiltration raise it."""
    base = 0.3 * similarity + 0.4 * novelty_ + 0.3 * confidence_
    base = F.when((similarity == 0) & (novelty_ == 0) & (confidence_ == 0), F.greatest(base, F.lit(0.5))).otherwise(base)
    weight = F.lit(None).cast("double")
    for name, value in CLASS_SEVERITY.items():
        weight = F.when(threat == name, F.lit(value)).otherwise(weight)
    scaled = base * F.coalesce(weight, F.lit(1.0))
    scaled = F.when(novelty_ > 0.8, scaled * (1 + 0.25 * F.least(F.lit(1.0), (novelty_ - 0.8) / 0.2))).otherwise(scaled)
    scaled = F.when(confidence_ < 0.5, scaled * (1 - 0.25 * (0.5 - confidence_))).otherwise(scaled)
    flags = 0.15 * lateral.cast("int") + 0.15 * exfiltration.cast("int")
    most = F.when(threat == "Benign", F.when(lateral | exfiltration, F.lit(0.45)).otherwise(F.lit(0.15))).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(scaled * (1 + flags), most))


def risk_level(score: Column) -> Column:
    return ladder(score, RISK_LEVELS, "MINIMAL")


def evidence_risk(supporting: Column, contradicting: Column) -> Column:
    """8 plus the weights for, less the weights against, within 0..100."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 8 + add(supporting) - F.abs(add(contradicting))))


def evidence_severity(score: Column) -> Column:
    return F.when(score <= 15, F.lit("LOW")).when(score <= 50, F.lit("MEDIUM")).when(score <= 80, F.lit("HIGH")).otherwise(F.lit("CRITICAL"))


def defence_decision(command: Column, stages: Column, n_events: Column, has_ioc: Column, scenario: Column) -> Column:
    """Struct (risk, confidence, decision) by the first rule that holds."""
    k = F.lower(F.coalesce(command, F.lit("")))
    any_stage = lambda *s: F.arrays_overlap(stages, F.array(*map(F.lit, s)))
    risk_ = (
        F.when(k.contains("lsass") | k.contains("mimikatz"), F.lit(0.95))
        .when(k.contains("powershell") & (k.contains("enc") | k.contains("download") | k.contains("bypass")), F.lit(0.88))
        .when(any_stage("CREDENTIAL_ACCESS", "COMMAND_AND_CONTROL"), F.lit(0.90))
        .when(any_stage("EXECUTION", "PERSISTENCE"), F.lit(0.75))
        .when(n_events >= 3, F.lit(0.65))
        .otherwise(F.lit(0.40))
    )
    conf = F.when(n_events >= 5, F.lit(0.92)).when(n_events >= 2, F.lit(0.78)).when(has_ioc | scenario, F.lit(0.85)).otherwise(F.lit(0.50))
    decision = (
        F.when((conf >= 0.85) & (risk_ >= 0.80), F.lit("CONFIRMED"))
        .when((risk_ >= 0.65) | (conf >= 0.70), F.lit("LIKELY"))
        .when(risk_ >= 0.35, F.lit("SUSPICIOUS"))
        .otherwise(F.lit("BENIGN"))
    )
    return F.struct(risk_.alias("risk"), conf.alias("confidence"), decision.alias("decision"))
