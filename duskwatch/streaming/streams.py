"""Streaming counterparts: the same expressions on readStream, with watermarks and bounded state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.steps import shared_dir
from duskwatch.sources.readers import syslog_events


def file_stream(spark: SparkSession, path: str, schema, files_at_once: int = 1, suffix: str = "*.parquet") -> DataFrame:
    """Files of a folder as they come, at most so many per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", suffix).parquet(path)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Syslog lines from a socket, parsed like the batch source."""
    return syslog_events(spark.readStream.format("socket").option("host", host).option("port", port).load())


def bucket_counts(stream: DataFrame, ts: str, late: str, width: str, slide: str | None, *by: Column | str) -> DataFrame:
    """Counts by tumbling or sliding window; a window is final once the watermark has passed it."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, ts: str, late: str, gap: str, *by: Column | str) -> DataFrame:
    """Counts by session of a key, closed by a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, ts: str, window: str, *keys: str) -> DataFrame:
    """First event of a key within the watermark; state of older keys is dropped."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark(list(keys))


def enriched(stream: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; the table is read again for each micro-batch."""
    return stream.join(table, key, "left")


def split_late(stream: DataFrame, ts: str, late: str, sink: Callable[[DataFrame, DataFrame, int], None], state: str | None = None):
    """A foreachBatch function that gives rows on time and late rows apart, against the newest time of earlier batches.

    The newest time of each batch is kept in the folder ``state``, one row a batch, so a restarted stream goes on where it
    stopped and a batch that is run again is split the same way. Without a folder it lives in the driver only. Rows without a
    time are on time.
    """
    newest: dict[int, object] = {}

    def before(spark: SparkSession, number: int):
        if state is None:
            return max((t for n, t in newest.items() if n < number and t is not None), default=None)
        spark.range(0).select(F.lit(None).cast("timestamp_ntz").alias("newest")).write.mode("overwrite").parquet(f"{state}/batch=-1")
        return spark.read.schema("newest timestamp_ntz, batch long").parquet(state).filter(F.col("batch") < number).agg(F.max("newest")).first()[0]

    def each(batch: DataFrame, number: int) -> None:
        seen = before(batch.sparkSession, number)
        limit = F.lit(seen) - F.expr(f"INTERVAL {late}") if seen is not None else None
        on_time = batch if limit is None else batch.filter(F.col(ts).isNull() | (F.col(ts) >= limit))
        tardy = batch.limit(0) if limit is None else batch.filter(F.col(ts) < limit)
        sink(on_time, tardy, number)
        top = batch.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("newest"))
        if state is None:
            newest[number] = top.first()[0]
        else:
            top.coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={number}")

    return stream.writeStream.foreachBatch(each)


def run_to_end(query_df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end, write what it puts out as Parquet to the shared folder, and read that.

    In complete mode every batch writes the whole result to a folder of its own; the newest is the result. In update mode all
    batches are kept, with their number in ``batch``.
    """
    spark = query_df.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last = {"path": None}

    def write(batch: DataFrame, number: int) -> None:
        last["path"] = f"{path}/result-{number}"
        batch.write.mode("overwrite").parquet(last["path"])

    writer = query_df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/result").start().awaitTermination()
        return spark.read.schema(query_df.schema).parquet(f"{path}/result")
    if mode == "update":
        add = lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/result/part={number}")
        writer.foreachBatch(add).start().awaitTermination()
        return spark.read.schema(query_df.withColumn("batch", F.lit(0).cast("long")).schema).parquet(f"{path}/result").drop("part")
    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(last["path"]) if last["path"] else spark.createDataFrame([], query_df.schema)
