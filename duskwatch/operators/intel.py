"""Indicator and threat-intelligence joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matching import substring_matches


def match_by_priority(events: DataFrame, key: str, indicators: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Best indicator hit per event: each family's value is joined once by equality, the first family in order wins.

    ``indicators`` has (family, value, label). Values are trimmed, and lower-cased but for urls; events without a
    hit are left out. The candidates are exploded, so one equi-join serves all families.
    """
    fold = lambda n, c: F.trim(c) if n == "url" else F.lower(F.trim(c))
    offers = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(n).alias("family"), fold(n, c).alias("value")) for i, (n, c) in enumerate(values.items())])
    asked = events.select(key, F.explode(offers).alias("o")).select(key, "o.*").filter("value is not null and value <> ''")
    hits = asked.join(indicators.select("family", "value", "label"), ["family", "value"])
    best = F.min(F.struct("priority", "family", "value", "label"))
    return hits.groupBy(key).agg(best.alias("b")).select(key, "b.family", "b.value", "b.label")


def containing(left: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """(key, word) for the words that occur anywhere in a text, upper and lower case alike; empty words match nothing."""
    lowered = left.select(key, F.lower(F.col(text)).alias("__text"))
    named = words.select(F.col(word).alias("__word"), F.lower(F.col(word)).alias("__low"))
    found = substring_matches(lowered, key, "__text", named, "__low").withColumnRenamed("word", "__low")
    return found.join(named, "__low").select(key, F.col("__word").alias(word))


def token_matches(left: DataFrame, key: str, text: str, words: DataFrame, word: str) -> DataFrame:
    """Distinct pairs whose text holds the word as a token: an equi-join that scales with both sides."""
    tokens = left.select(key, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_.]+"))).alias("token"))
    return tokens.join(words.select(F.lower(F.col(word)).alias("token"), word), "token").select(key, word).distinct()


def lookup(events: DataFrame, feed: DataFrame, left: Column, right: Column, columns: dict[str, str]) -> DataFrame:
    """Left join to a feed on normalised keys; no row is lost, unmatched columns are null."""
    slim = feed.groupBy(right.alias("__key")).agg(*[F.min(source).alias(out) for source, out in columns.items()])
    return events.join(slim, left == F.col("__key"), "left").drop("__key")
