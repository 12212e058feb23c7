"""Writes: append-only logs with current-state views, since plain Parquet has no MERGE.

An upsert appends a row with its time; the view takes the latest row of each key. Appends commit whole files,
so a failed job leaves nothing half-written, and concurrent writers don't lose each other's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import latest

# Limits of settings that have some.
SETTING_LIMITS = {"query_timeout_ms": ("int", 1, 60_000), "similarity_threshold": ("float", 0, 1), "max_nodes": ("int", 1, 1000), "enabled": ("bool", None, None)}


def append(df: DataFrame, path: str, at: Column | None = None, partition_by: str | None = None) -> None:
    """Append rows to a log, with the time of writing."""
    writer = df.withColumn("logged_at", at if at is not None else F.current_timestamp()).write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def current(spark: SparkSession, path: str, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Latest row of each key of a log; rows marked as deleted are gone."""
    log = spark.read.parquet(path)
    state = latest(log, key, order or [F.desc("logged_at")])
    return state.filter("not coalesce(deleted, false)") if "deleted" in log.columns else state


def with_status(df: DataFrame, cond: Column, status: str) -> DataFrame:
    """Rows that the condition picks get the status."""
    return df.withColumn("status", F.when(cond, F.lit(status)).otherwise(F.col("status")))


def replace(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace a whole table or JSON document. Readers may find nothing meanwhile; ``tables.publish`` shows them one version or the next."""
    df.write.mode("overwrite").format(kind).save(path)


def telemetry_row(df: DataFrame) -> DataFrame:
    """Nested events as stored rows: often-used fields as columns, nested or flat, and the event as JSON."""
    pick = lambda nested, flat: F.coalesce(*[F.col(c) for c in (nested, flat) if _has(df, c)] or [F.lit(None).cast("string")])
    return df.select(
        "event_id", "ts", "source_mode", "event_type", pick("process.name", "process_name").alias("process_name"), pick("network.src_ip", "src_ip").alias("src_ip"),
        pick("network.dst_ip", "dst_ip").alias("dst_ip"), F.to_json(F.struct("*")).alias("event_json"),
    )


def _has(df: DataFrame, name: str) -> bool:
    top, _, inner = name.partition(".")
    if top not in df.columns:
        return False
    return not inner or inner in getattr(df.schema[top].dataType, "names", ())


def setting_error(key: Column, value: Column) -> Column:
    """Why a setting is refused, null if it is accepted; keys without limits are accepted."""
    out = F.lit(None).cast("string")
    for name, (kind, low, high) in SETTING_LIMITS.items():
        if kind == "bool":
            wrong = F.when(~F.lower(value).isin("true", "false", "1", "0", "yes", "no"), "not a boolean")
        else:
            number = value.try_cast("long" if kind == "int" else "double")
            wrong = F.when(number.isNull(), f"not a {kind}").when(~number.between(low, high), "out of range")
        out = F.when(key == name, wrong).otherwise(out)
    return out


def setting_history(log: DataFrame) -> DataFrame:
    """Versions of each setting in order of time, with the value before."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("logged_at", "value")
    return log.select("key", "value", "logged_at", F.row_number().over(w).alias("version"), F.lag("value").over(w).alias("old_value"))


def reset_settings(spark: SparkSession, path: str, module: str | None = None) -> int:
    """Mark the settings of a module, or all, as deleted; returns how many there were."""
    rows = current(spark, path, ["key"])
    rows = rows if module is None else rows.filter(F.col("module") == module)
    gone = rows.drop("logged_at").withColumn("deleted", F.lit(True))
    n = gone.count()
    if n:
        append(gone, path)
    return n


def sigma_rule(title: Column, command_word: Column, level: Column) -> Column:
    """Text of a detection rule in Sigma's YAML."""
    return F.format_string("title: %s\nlogsource:\n  category: process_creation\ndetection:\n  selection:\n    CommandLine|contains: '%s'\n  condition: selection\nlevel: %s\n", title, command_word, level)


def yara_rule(name: Column, strings: Column) -> Column:
    """Text of a YARA rule that any of the strings fires."""
    lines = F.transform(strings, lambda s, i: F.format_string('    $s%d = "%s"', i, F.replace(s, F.lit('"'), F.lit('\\"'))))
    return F.concat(F.lit("rule "), F.regexp_replace(name, r"\W", "_"), F.lit(" {\n  strings:\n"), F.array_join(lines, "\n"), F.lit("\n  condition:\n    any of them\n}\n"))


def export_bundle(settings: DataFrame) -> DataFrame:
    """All settings as one JSON text; settings are few."""
    return settings.agg(F.to_json(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("bundle"))


def import_bundle(bundle: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with error) settings of a JSON text."""
    rows = bundle.select(F.explode(F.from_json("bundle", "array<struct<key:string,value:string>>")).alias("s")).select("s.*")
    checked = rows.withColumn("error", setting_error(F.col("key"), F.col("value")))
    return checked.filter("error is null").drop("error"), checked.filter("error is not null")
