"""Tables that are replaced as a whole, and rows with two unique keys.

A version is a folder of Parquet files that nobody changes. It counts from the moment its row is in the table's log, which is
appended last and whole, so readers see one version or the next. A writer that dies leaves files that no version names.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks

_LOG = "version long, folder string, logged_at timestamp"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, logged_at) of each version; of two writers that took the same number, the later one's. None before the first."""
    try:
        log = spark.read.schema(_LOG).parquet(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)
    return log.groupBy("version").agg(F.max(F.struct("logged_at", "folder")).alias("last")).select("version", "last.folder", "last.logged_at")


def write_version(df: DataFrame, path: str) -> str:
    """Write the rows as files that no reader sees yet; returns their folder."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    return folder


def publish(df: DataFrame, path: str) -> int:
    """Make the rows the next version of the table; returns its number, from 1. The rows may come from the table itself."""
    spark = df.sparkSession
    folder = write_version(df, path)
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    sinks.append(spark.range(1).select(F.lit(number).cast("long").alias("version"), F.lit(folder).alias("folder")).coalesce(1), f"{path}/log")
    return number


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, else of the newest. It stays the same for this DataFrame, whatever is published meanwhile."""
    found = versions(spark, path)
    row = (found if version is None else found.filter(F.col("version") == version)).orderBy(F.desc("version")).first()
    if row is None:
        raise ValueError(f"{path} has no version {version if version is not None else 'yet'}")
    return spark.read.parquet(f"{path}/{row.folder}")


def compact(spark: SparkSession, path: str, files: int) -> int:
    """Publish the newest version again in so many files."""
    return publish(read_version(spark, path).repartition(files), path)


def replaced(log: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """What a log of writes leaves if a write deletes all earlier rows that share one of several unique columns with it.

    A row stays if it is the last write of each of its values. Null values clash with nothing. Of rows that tie on
    ``order``, all that are last stay, so the order should end with a column that tells rows apart.
    """
    at, out = F.struct(*order), log.withColumn("__at", F.struct(*order))
    for c in unique:
        last = log.filter(F.col(c).isNotNull()).groupBy(c).agg(F.max(at).alias("__at")).select(F.col(c).alias("__value"), F.col("__at").alias("__last"))
        # by value and time together, so that a value with many writes isn't one task
        kept = out.join(last, (F.col(c) == F.col("__value")) & (F.col("__at") == F.col("__last")), "left_semi")
        out = kept.unionByName(out.filter(F.col(c).isNull()))
    return out.drop("__at")
