"""Streams over the events file, run to their end, compared with what a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.streaming import keyed, streams

from .registry import register


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = streams.file_stream(spark, f"{sf_dir}/events.parquet*", schema)  # one file, or a folder of files
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tumbling counts of a stream, put out complete at its end."""
    counts = streams.bucket_counts(_stream(spark, sf_dir), "ts", "1 hour", "1 day", None, "event_type")
    rows = streams.run_to_end(counts, "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@register("stream_dedupe", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = streams.deduplicated(_stream(spark, sf_dir), "ts", "60 days", "user_id", "event_type")
    return streams.run_to_end(first).select("user_id", "event_type")


@register(
    "session_windows",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, session
    """,
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = streams.session_counts(_stream(spark, sf_dir), "ts", "1 hour", "6 hours", "user_id")
    rows = streams.run_to_end(sessions, "complete")
    return rows.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), "n")


@register(
    "rolling_rate",
    """
    WITH s AS (SELECT date_trunc('hour', ts) AS h, event_type FROM events), w AS (SELECT h - to_hours(i) AS start, event_type FROM s, range(3) r(i))
    SELECT start, event_type, count(*) AS n, count(*) / 10800.0e0 AS rate FROM w GROUP BY ALL
    """,
)
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per second over sliding windows of three hours by the hour."""
    counts = streams.bucket_counts(_stream(spark, sf_dir), "ts", "1 hour", "3 hours", "1 hour", "event_type")
    rows = streams.run_to_end(counts, "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.col("n") / 10800.0).alias("rate"))


@register(
    "stream_first_sight",
    """
    WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE ts IS NOT NULL),
    k AS (SELECT user_id, min(us) AS us FROM o GROUP BY 1 UNION ALL SELECT o.user_id, min(o.us) FROM k JOIN o ON o.user_id = k.user_id AND o.us >= k.us + 3600000000 GROUP BY o.user_id, k.us)
    SELECT k.user_id, min(o.event_id) AS event_id FROM k JOIN o ON o.user_id = k.user_id AND o.us = k.us GROUP BY k.user_id, k.us
    """,
)
def stream_first_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are no repeat within the hour after the last one kept of their user."""
    rows = streams.run_to_end(keyed.first_sights(_stream(spark, sf_dir), "user_id", "ts", "event_id", 3600, "60 days"))
    return rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"))


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.run_to_end(keyed.newest(_stream(spark, sf_dir), "event_type", "ts", "event_id"), "update")
    return rows.join(rows.groupBy("key").agg(F.max("batch").alias("batch")), ["key", "batch"])


@register(
    "stream_newest",
    "SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS INTEGER) AS place FROM events WHERE ts IS NOT NULL QUALIFY place <= 100",
)
def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred newest events of each type, as the stream holds them at its end."""
    return _newest(spark, sf_dir).select(F.col("key").alias("event_type"), F.col("id").alias("event_id"), "place")


@register("stream_freshness", "SELECT event_type, (SELECT max(epoch_us(ts)) FROM events) - max(epoch_us(ts)) < 900000000 AS fresh FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event types had an event in the quarter of an hour before the newest of all."""
    held = _newest(spark, sf_dir)
    now = held.agg(F.max("at")).first()[0] or 0
    return keyed.freshness(held, now).select(F.col("key").alias("event_type"), "fresh")
