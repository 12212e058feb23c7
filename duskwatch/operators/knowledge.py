"""Pattern store, analyst feedback, indicator repository and their statistics, over append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matching import first_of_each, first_patterns, possible_words, substring_matches
from .steps import stored

# States that count, kinds of feedback, what follows from each, and the sections of an indicator file.
REJECTED, CONFIRMED, UNREVIEWED = "Analyst Rejected", "Analyst Confirmed", "Unreviewed"
FEEDBACK = ("true_positive", "false_positive", "false_negative")
NEXT_ACTIONS = {
    "false_negative": ["add_to_training_data", "trigger_pattern_learning", "review_detection_rules"],
    "false_positive": ["adjust_detection_threshold", "review_feature_weights", "add_to_whitelist"],
    "true_positive": ["reinforce_pattern", "update_campaign_signature"],
}
INDICATOR_SECTIONS = ("hashes", "ips", "domains", "urls", "cves")
RETRAIN_EVERY = 100
VECTOR_SIZE = 128


def pattern_error(vector: Column, size: int = VECTOR_SIZE) -> Column:
    """Why a pattern is refused, null if it may be stored."""
    return F.when(vector.isNull(), F.lit("no embedding")).when(F.size(vector) != size, F.lit("wrong size"))


def feedback_error(kind: Column, profile: Column, analyst: Column) -> Column:
    """Name of the first field of a feedback that is missing or unknown; null if it is valid."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    return F.when(empty(profile), F.lit("profile_id")).when(~F.coalesce(kind.isin(*FEEDBACK), F.lit(False)), F.lit("feedback_type")).when(empty(analyst), F.lit("analyst_id"))


def score_error(similarity: Column, novelty: Column, quality: Column, patterns: Column) -> Column:
    """Name of the first score outside 0..1, or of a negative number of patterns; null if all are in range."""
    wrong = lambda c: ~F.coalesce(c.between(0, 1), F.lit(False))
    return (
        F.when(wrong(similarity), F.lit("similarity_score")).when(wrong(novelty), F.lit("novelty_score")).when(wrong(quality), F.lit("evidence_quality"))
        .when(F.coalesce(patterns < 0, F.lit(True)), F.lit("knowledge_base_size"))
    )


def next_actions(kind: Column, total: Column) -> Column:
    """What to do after a feedback; every hundredth feedback asks for retraining as well."""
    table = F.create_map(*[x for k, v in NEXT_ACTIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.try_element_at(table, kind), F.array().cast("array<string>"))
    return F.when(total % RETRAIN_EVERY == 0, F.concat(own, F.array(F.lit("trigger_model_retraining")))).otherwise(own)


def feedback_history(log: DataFrame, key: str = "pattern_id", status: str = "new_status", order: tuple[str, ...] = ("ts", "feedback_id")) -> DataFrame:
    """The log with previous_status, false_positive_count and analyst_confirmed_count after each entry.

    A counter only rises when the status changes to its state, so repeating a verdict changes nothing. The state before
    the first entry is "Unreviewed". Rows tied on ``order`` are taken in any order.
    """
    w = Window.partitionBy(key).orderBy(*order)
    seen = log.withColumn("previous_status", F.coalesce(F.lag(status).over(w), F.lit(UNREVIEWED)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rises = lambda state: F.sum(((F.col(status) == state) & (F.col("previous_status") != state)).cast("long")).over(so_far)
    return seen.withColumns({"false_positive_count": rises(REJECTED), "analyst_confirmed_count": rises(CONFIRMED)})


def pattern_states(patterns: DataFrame, log: DataFrame, key: str = "pattern_id", status: str = "new_status", order: tuple[str, ...] = ("ts", "feedback_id")) -> DataFrame:
    """Patterns with the state and counters that the log leaves them in; patterns without feedback are unreviewed."""
    history = feedback_history(log, key, status, order)
    last = history.groupBy(key).agg(
        F.max_by(status, F.struct(*order)).alias("validation_status"), F.max("false_positive_count").alias("false_positive_count"),
        F.max("analyst_confirmed_count").alias("analyst_confirmed_count"), F.max(order[0]).alias("reviewed_at"),
    )
    zero = {"validation_status": UNREVIEWED, "false_positive_count": 0, "analyst_confirmed_count": 0}
    return patterns.join(last, key, "left").fillna(zero)


def false_negative_patterns(feedback: DataFrame, vectors: DataFrame) -> DataFrame:
    """A new pattern for each false negative whose profile has a vector: corrected label, confidence 0.8 and where it comes from."""
    missed = feedback.filter(F.col("feedback_type") == "false_negative").join(vectors, "profile_id")
    origin = F.struct("feedback_id", "analyst_id", "profile_id")
    return missed.select(
        F.concat(F.lit("fn-"), F.col("feedback_id").cast("string")).alias("pattern_id"), "embedding", F.coalesce("corrected_label", F.lit("Unknown")).alias("threat_class"),
        F.lit(0.8).alias("confidence_score"), F.lit("feedback_false_negative").alias("source"), origin.alias("metadata"),
    )


def promote_campaigns(campaigns: DataFrame) -> DataFrame:
    """Validated campaigns as rows of the knowledge base, with their defaults; an attribution of type UNKNOWN counts as none."""
    named = F.when(F.coalesce("attribution_type", F.lit("UNKNOWN")) != "UNKNOWN", F.col("attribution_name"))
    return campaigns.select(
        "campaign_id", F.coalesce("campaign_name", F.concat(F.lit("Campaign "), F.col("campaign_id").cast("string"))).alias("campaign_name"), F.lit("BEHAVIORAL").alias("threat_class"),
        F.coalesce("technique_ids", F.array().cast("array<string>")).alias("common_techniques"), "first_seen", "last_seen",
        F.size(F.coalesce("evidence_event_ids", F.array().cast("array<long>"))).cast("long").alias("detection_count"), F.coalesce(named, F.lit("UNKNOWN")).alias("attribution"),
    )


def analyst_trail(changes: DataFrame, key: str = "campaign_id", order: tuple[str, ...] = ("ts", "change_id")) -> DataFrame:
    """One row per change of an analyst's verdict: its number in the campaign's trail, action, actor and notes; missing notes say what changed."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    note = F.concat(F.lit("Analyst changed validation status to "), F.col("analyst_status"))
    return changes.select(
        key, number.alias("entry"), F.col(order[0]).alias("timestamp"), F.concat(F.lit("ANALYST_"), F.upper("analyst_status")).alias("action"),
        F.coalesce("actor", F.lit("Analyst")).alias("actor"), F.coalesce(F.nullif(F.col("notes"), F.lit("")), note).alias("notes"),
    )


def by_id_or_fingerprint(patterns: DataFrame, value: str) -> DataFrame:
    return patterns.filter((F.col("pattern_id").cast("string") == value) | (F.col("fingerprint") == value))


def class_statistics(patterns: DataFrame) -> DataFrame:
    """Patterns and mean confidence by class, and over all in the row without a class."""
    return patterns.filter("threat_class is not null").rollup("threat_class").agg(F.count("*").alias("patterns"), F.avg("confidence_score").alias("mean_confidence"))


def feedback_summary(feedback: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Feedback younger than ``days`` by type, by analyst and in all, with the number per day."""
    recent = feedback.filter(F.col("ts") > as_of - F.make_dt_interval(F.lit(days)))
    counts = recent.groupingSets([["feedback_type"], ["analyst_id"], []], "feedback_type", "analyst_id").agg(F.count("*").alias("n"))
    return counts.withColumn("per_day", F.col("n") / F.lit(float(days)))


def estimated_performance(feedback: DataFrame, least: int = 10) -> DataFrame:
    """Accuracy, precision, recall and F1 that feedback lets one expect; no row for fewer than ``least`` of it."""
    counts = feedback.agg(*[F.count_if(F.col("feedback_type") == k).alias(n) for k, n in zip(FEEDBACK, ("tp", "fp", "fn"))], F.count("*").alias("every"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counts.filter(F.col("every") >= least).select(
        share(tp, tp + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), (tp + fp + fn).alias("feedback_samples")
    )
    return out.withColumn("f1_score", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def active_versions(log: DataFrame, key: str = "model", order: tuple[str, ...] = ("activated_at", "version")) -> DataFrame:
    """The version of each model that was activated last; a rollback is a further activation."""
    return log.groupBy(key).agg(F.max_by("version", F.struct(*order)).alias("version"), F.max(order[0]).alias(order[0]))


def with_defaults(defaults: DataFrame, values: DataFrame, key: str = "setting") -> DataFrame:
    """Every setting of the schema with its stored value, else its default, and whether it is stored."""
    stored = values.select(key, F.col("value").alias("stored"))
    return defaults.join(stored, key, "left").select(key, F.coalesce("stored", "default").alias("value"), F.col("stored").isNotNull().alias("overridden"))


def indicator_rows(documents: DataFrame) -> DataFrame:
    """(family, value, label) of indicator documents with one map per section; values are trimmed, hashes, domains and CVE ids folded."""
    fold = {"hashes": F.lower, "domains": F.lower, "cves": F.upper}
    parts = [documents.select(F.lit(s).alias("family"), F.explode(s).alias("value", "label")).withColumn("value", fold.get(s, lambda c: c)(F.trim("value"))) for s in INDICATOR_SECTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("value <> ''").groupBy("family", "value").agg(F.max("label").alias("label"))


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """Indicators of a JSON document with five sections of value to label."""
    schema = ", ".join(f"{s} map<string,string>" for s in INDICATOR_SECTIONS)
    return indicator_rows(spark.read.option("multiLine", True).schema(schema).json(path))


def save_indicators(indicators: DataFrame, path: str) -> None:
    """One table, a folder for each family."""
    indicators.write.mode("overwrite").partitionBy("family").parquet(path)


def indicator_counts(indicators: DataFrame) -> DataFrame:
    """Indicators by family, and in all in the row "total"."""
    return indicators.rollup("family").agg(F.count("*").alias("n")).withColumn("family", F.coalesce("family", F.lit("total")))


def not_listed(alerts: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Alerts whose key is on no list; a null key is never listed."""
    return alerts.join(listed.select(key).distinct(), key, "left_anti")


def parse_statistics(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Records read and refused, and the share of each; shares are 0 without records."""
    counts = good.select(F.lit(True).alias("ok")).unionByName(bad.select(F.lit(False).alias("ok"))).agg(F.count_if("ok").alias("parsed"), F.count_if(~F.col("ok")).alias("errors"))
    total = F.col("parsed") + F.col("errors")
    share = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))
    return counts.withColumns({"success_rate": share("parsed"), "error_rate": share("errors")})


def pattern_matches(evidence: DataFrame, key: str, patterns: DataFrame, most: int = 5, fallback: tuple[str, ...] = ("CAPEC-112", "CAPEC-223", "CAPEC-66")) -> DataFrame:
    """Of each profile the first ``most`` attack patterns whose name or description holds one of its keywords.

    ``evidence`` has (key, keyword), ``patterns`` (pattern_id, name, description). Keywords of three letters or fewer
    match nothing. First is by id. A profile without a match gets the fallback patterns that exist. Equal texts of patterns
    are read once for all different keywords, however many profiles hold them; of each text only its first ``most`` patterns can count.
    """
    text = patterns.select("pattern_id", F.lower(F.concat_ws("\n", "name", "description")).alias("text"))
    first = stored(first_of_each(text, "text", most), "first")
    texts = stored(first.select("text").distinct().withColumn("id", F.monotonically_increasing_id()), "texts")
    asked = possible_words(evidence.filter(F.length("keyword") > 3).select(key, F.lower("keyword").alias("word")), "word", texts, "text")
    asked = stored(asked, "asked")
    met = substring_matches(texts, "id", "text", asked.select("word").distinct(), "word")
    held = met.join(texts, "id").join(first, "text").select("word", "pattern_id")
    found = ranked = stored(first_patterns(asked, key, held, most), "patterns")
    general = patterns.filter(F.col("pattern_id").isin(*fallback)).select("pattern_id", F.row_number().over(Window.orderBy("pattern_id")).alias("rank"))
    rest = evidence.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(general))
    return ranked.unionByName(rest.select(key, "pattern_id", "rank"))
