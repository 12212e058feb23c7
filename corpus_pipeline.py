"""The corpus pipeline: toxicity, near duplicates, benchmark passages, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm.decontaminate import contamination
from duskwatch.llm.mixing import mix
from duskwatch.llm.near_copies import near_copies
from duskwatch.llm.token_store import read_store, write_store
from duskwatch.llm.toxic_spans import fit_toxic, score_toxic

#: SQL can express none of toxicity, SimHash, mixing by hash order and token ids.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, doesn't call toxic.

    Rows without an id stay; rows that repeat an id go together, if one of them is toxic.
    """
    model = fit_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = score_toxic(docs, model, with_spans=False).filter("score >= 0.5").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; of rows that repeat it, one."""
    return near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id stay; rows that repeat an id go together."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every epoch in which the mix takes words of it; whole documents, so a source may exceed its target by part of one."""
    mixed = mix(docs, carry=tuple(docs.columns))
    copies = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    rows = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return rows.select("carried.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token store and read it back: doc_id, start, n_tokens, ids_crc32."""
    return read_store(write_store(docs), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_store", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    from duskwatch.llm.shared import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
