"""Helpers that the training-data operators have in common."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of text that a task turns into Python objects at once; a longer text is one such piece by itself.
TEXT_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and Python workers.
BATCH_BYTES = 8 << 20

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset in local mode, as in tests, a folder below the temp folder takes its place.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return configured or f"file://{tempfile.gettempdir()}/checkpoints"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/duskwatch-{os.getpid()}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that stored() wrote and nothing reads any more, and free finished shuffles."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        remove(table.sparkSession, path)
    release(table.sparkSession)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this driver wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with just the named input columns, under the operator's own names: other columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not whenever the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_store(uri: str):
    """(file system, path) of a URI for reading and writing bytes within tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def slices(batch: pa.RecordBatch, column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most ``most`` bytes of text together, one row at least: all rows, bounded memory."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def small_batches(spark: SparkSession) -> None:
    """Let this session hand Arrow batches of at most ``BATCH_BYTES`` to Python; a smaller setting stays as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(name).rstrip("b")
    if not bound.isdigit() or int(bound) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def whole_runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]]:
    """From sorted batches: the columns of one or more whole runs of rows with equal first ``keys`` columns, and where runs start and end.

    A run may span batches; its parts are put together once.
    """
    parts: list[tuple[np.ndarray, ...]] = []

    def cut(last: bool):
        rows = tuple(np.concatenate(x) for x in zip(*parts))
        change = np.zeros(len(rows[0]) - 1, bool)
        for k in rows[:keys]:
            change |= k[1:] != k[:-1]
        starts = np.append(0, np.flatnonzero(change) + 1)
        ends = np.append(starts[1:], len(rows[0]))
        rest = [] if last else [tuple(x[starts[-1] :].copy() for x in rows)]
        return (rows, starts, ends) if last else (rows, starts[:-1], ends[:-1]), rest

    for batch in batches:
        if not len(batch):
            continue
        parts.append(tuple(_numbers(batch.column(c)) for c in columns))
        if all(parts[0][k][0] == parts[-1][k][-1] for k in range(keys)):
            continue
        found, parts = cut(last=False)
        yield found
    if parts:
        yield cut(last=True)[0]


def _numbers(column: pa.Array) -> np.ndarray:
    """Numbers as they are; binary values of equal length as rows of bytes."""
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return column.to_numpy()


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
