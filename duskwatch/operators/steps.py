"""Tables between the steps of operators that loop or read a result twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset in local mode, the temp folder."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (configured or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/steps/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, *keys: str, deal: bool = True) -> DataFrame:
    """Like ``stored``, in one bucket of the keys for each shuffle partition: tables of the same keys are joined where they lie.

    Without ``deal`` the rows are written as they come, for rows that a join of such tables made.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    rows = df.repartition(parts, *keys) if deal else df
    rows.write.bucketBy(parts, *keys).option("path", f"{shared_dir(spark)}/steps/{table}").saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {table}")
    return found
