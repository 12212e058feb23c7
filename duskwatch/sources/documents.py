"""Files that are one document each: program metadata, stored knowledge, and the registry of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators import sinks
from duskwatch.operators.windows import latest

from .telemetry_events import PE_METADATA, PE_OBJECT

# Classes of patterns, and kinds, statuses and formats of data sets.
CLASSES = ("APT", "Ransomware", "Insider_Threat", "Malware", "Phishing", "Benign")
KINDS = ("endpoint_telemetry", "network_traffic", "authentication_logs", "malware_samples", "threat_intelligence", "attack_patterns", "vulnerabilities", "honeypot_logs")
STATUSES = ("available", "processing", "ingested", "error", "not_found")
FORMATS = ("json", "csv", "xml", "parquet", "pkl", "netflow", "pcap", "stix", "cdm")
# Data sets known from the start, as (id, name, kind, format).
DESCRIPTORS = (
    ("darpa_optc", "DARPA OpTC", "endpoint_telemetry", "cdm"),
    ("darpa_tc_cti", "DARPA TC CTI", "attack_patterns", "stix"),
    ("ctu13", "CTU-13 Botnet Dataset", "network_traffic", "netflow"),
    ("cicids_1000", "CICIDS-1000.csv", "network_traffic", "csv"),
    ("cicids_333", "CICIDS-333.csv", "network_traffic", "csv"),
    ("cicids_658", "CICIDS-658.csv", "network_traffic", "csv"),
    ("ember", "EMBER Malware Dataset", "malware_samples", "json"),
    ("sorel_20m", "SOREL-20M", "malware_samples", "json"),
    ("tpot_honeypot", "T-Pot Community Edition", "honeypot_logs", "json"),
    ("mhn_honeypot", "Modern Honey Network", "honeypot_logs", "json"),
    ("mitre_attack", "MITRE ATT&CK", "threat_intelligence", "stix"),
    ("capec", "CAPEC Attack Patterns", "attack_patterns", "xml"),
    ("cisa_kev", "CISA KEV Catalog", "vulnerabilities", "csv"),
    ("cve_list", "CVE List v5", "vulnerabilities", "json"),
    ("ember_features_pkl", "EMBER Pre-extracted Features", "malware_samples", "pkl"),
)
DATASET = "dataset_id string, name string, kind string, format string, status string, path string, record_count long, size_mb double"
_PATTERN = "pattern_id string, threat_class string, source string, confidence double, created_at string, embedding array<double>"


def read_pe_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Program metadata, one JSON object or array a file, with the ``file`` it came from and the 64 hex digits of its path as
    ``sha256`` (null without). Unreadable files have null parts."""
    rows = spark.read.schema(PE_METADATA).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path"))
    return rows.withColumn("sha256", F.nullif(F.lower(F.regexp_extract("file", r".*(?<![0-9a-fA-F])([0-9a-fA-F]{64})(?![0-9a-fA-F])", 1)), F.lit("")))


def read_pe_objects(spark: SparkSession, path: str) -> DataFrame:
    """Program objects, one JSON object a line; lines that can't be read are left out."""
    return spark.read.schema(PE_OBJECT).option("mode", "DROPMALFORMED").json(path)


def read_patterns(spark: SparkSession, path: str, size: int = 128) -> tuple[DataFrame, DataFrame]:
    """(patterns, refused with error) of knowledge documents: JSON objects whose ``patterns`` are the records.

    Each record is checked on its own; the last of a pattern_id in the order of files and places wins. A document that can't be
    read gives no row.
    """
    documents = spark.read.schema("patterns array<string>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    texts = documents.select(F.col("_metadata.file_path").alias("file"), F.posexplode("patterns").alias("place", "record"))
    rows = texts.withColumn("p", F.from_json("record", _PATTERN)).select("file", "place", "record", "p.*")
    error = (
        F.when(F.coalesce("pattern_id", F.lit("")) == "", "no pattern_id")
        .when(~F.coalesce(F.col("threat_class").isin(*CLASSES), F.lit(False)), "unknown class")
        .when(F.coalesce(F.size("embedding"), F.lit(-1)) != size, "wrong size of vector")
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x)), "missing number in vector")
    )
    checked = rows.withColumn("error", error)
    good = latest(checked.filter("error is null"), ["pattern_id"], [F.desc("file"), F.desc("place")])
    return good.drop("file", "place", "record", "error"), checked.filter("error is not null").select("file", "place", "record", "error")


def write_patterns(patterns: DataFrame, path: str, per_document: int = 1000) -> None:
    """Patterns as knowledge documents of about so many records, spread by a hash of their id; those without one by all that they hold."""
    documents = F.greatest(F.lit(1), F.ceil(F.lit(patterns.count() / per_document))).cast("int")
    spread = F.when(F.coalesce("pattern_id", F.lit("")) == "", F.xxhash64(*patterns.columns)).otherwise(F.xxhash64("pattern_id"))
    held = patterns.withColumn("document", F.pmod(spread, documents)).groupBy("document")
    texts = held.agg(F.collect_list(F.struct(*patterns.columns)).alias("patterns"), F.count("*").alias("n"))
    body = F.to_json(F.struct("patterns", F.struct(F.lit("1.0").alias("version"), F.col("n").alias("pattern_count")).alias("metadata")))
    texts.select("document", body.alias("value")).write.partitionBy("document").text(path)


def of_class(patterns: DataFrame, threat_class: str) -> DataFrame:
    """Patterns of a class; an unknown class is an error."""
    if threat_class not in CLASSES:
        raise ValueError(f"unknown class {threat_class!r}; known are {', '.join(CLASSES)}")
    return patterns.filter(F.col("threat_class") == threat_class)


def known_datasets(spark: SparkSession) -> DataFrame:
    """The data sets known from the start, all available and without counts."""
    rows = [(*d, "available", None, None, None) for d in DESCRIPTORS]
    return spark.createDataFrame(rows, DATASET)


def dataset_error(dataset_id: Column, kind: Column, fmt: Column, status: Column) -> Column:
    """Why a data set is refused, null if it is accepted."""
    out = F.when(F.coalesce(dataset_id, F.lit("")) == "", "no id")
    for what, value, allowed in (("kind", kind, KINDS), ("format", fmt, FORMATS), ("status", status, STATUSES)):
        out = out.when(~F.coalesce(value.isin(*allowed), F.lit(False)), f"unknown {what}")
    return out


def register_datasets(datasets: DataFrame, log: str) -> DataFrame:
    """Append valid data sets to the registry's log, where the last entry of an id counts; returns the refused with their error."""
    checked = datasets.withColumn("error", dataset_error(F.col("dataset_id"), F.col("kind"), F.col("format"), F.col("status")))
    sinks.append(checked.filter("error is null").drop("error"), log)
    return checked.filter("error is not null")


def datasets(spark: SparkSession, log: str, kind: str | None = None, status: str | None = None) -> DataFrame:
    """The registry, all or of a kind and a status."""
    rows = sinks.current(spark, log, ["dataset_id"])
    for column, value, allowed in (("kind", kind, KINDS), ("status", status, STATUSES)):
        if value is not None:
            if value not in allowed:
                raise ValueError(f"unknown {column} {value!r}; known are {', '.join(allowed)}")
            rows = rows.filter(F.col(column) == value)
    return rows


def dataset_statistics(registry: DataFrame) -> DataFrame:
    """(kind, status, format, n, records, size_mb): totals for each kind, each status, each format and over all, in one pass."""
    c = [F.col(x) for x in ("kind", "status", "format")]
    return registry.groupingSets([[c[0]], [c[1]], [c[2]], []], *c).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.coalesce(F.sum("size_mb"), F.lit(0.0)).alias("size_mb")
    )
