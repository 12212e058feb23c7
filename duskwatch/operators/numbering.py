"""Exact row numbers over all rows, chunks of them, and one pattern for each chunk of a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .steps import stored

#: Rows that a range may hold: the place within a partition takes the lower 33 bits of an id.
_PLACE = (1 << 33) - 1
# Events of a chunk; classes, source and confidence of patterns that are read in.
CHUNK, MALICIOUS, BENIGN, SOURCE, CONFIDENCE = 100, "Malware", "Benign", "imported", 0.9


def numbered(df: DataFrame, order: list[str | Column], by: list[str] | None = None, name: str = "number", partitions: int | None = None) -> DataFrame:
    """All rows with their number from 1 in the order, within each group of ``by``.

    Rows are sorted in ranges of (by, order), which cut through large groups, and a range starts where the totals of the
    ranges before it end. No task holds more than a range, and rows that tie on everything are spread over ranges too; their
    numbers are distinct, in any order. Nulls come first, null groups are groups.
    """
    by, spark = list(by or []), df.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order, "__tie"]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = stored(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ranges").withColumn("__range", F.shiftright("__at", 33))
    totals = rows.groupBy("__range", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *by, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")).toDF("__r", *[f"__by{i}" for i in range(len(by))], "__first", "__start")
    same = F.col("__range") == F.col("__r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    place = F.col("__at").bitwiseAND(F.lit(_PLACE)) - F.col("__first").bitwiseAND(F.lit(_PLACE))
    return rows.join(starts, same).select(*df.columns, (F.col("__start") + place + 1).alias(name))


def chunks(df: DataFrame, order: list[str], by: list[str] | None = None, size: int = CHUNK) -> DataFrame:
    """All rows with ``chunk``, from 0: consecutive ``size`` rows of each group in the order."""
    return numbered(df, order, by, "chunk").withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("long"))


def retention(df: DataFrame, order: list[str | Column], protected: Column, most: int) -> DataFrame:
    """Rows that stay when the lowest rows above ``most`` go; rows that are protected, or for which that is null, always stay.

    Rows that go are told by their number, so of equal rows exactly as many go as must. Without an excess nothing is sorted.
    """
    excess = df.count() - most
    if excess <= 0:
        return df
    rest = numbered(df.filter(~protected), order, name="__number").filter(F.col("__number") > excess).drop("__number")
    return df.filter(F.coalesce(protected, F.lit(True))).unionByName(rest)


def chunk_patterns(events: DataFrame, dataset: str, node: str, action: str, ts: str, actor: str, malicious: Column, malicious_class: Column | None = None, size: int = CHUNK) -> DataFrame:
    """One pattern for every ``size`` events of a data set in order of time: class, size of its graph, features and embedding.

    A chunk is malicious if one of its events is; null counts as no. ``malicious_class`` names the class of a data set's
    malicious chunks. Events without a time come first, as in all graphs.
    """
    rows = events.select(F.col(dataset).alias("dataset"), F.col(node).alias("node"), F.col(action).alias("action"), F.col(ts).alias("ts"), F.col(actor).alias("actor"), malicious.alias("bad"), (malicious_class if malicious_class is not None else F.lit(MALICIOUS)).alias("kind"))
    cut = chunks(rows, ["ts", "node"], ["dataset"], size).withColumn("graph", F.to_json(F.struct("dataset", "chunk")))
    cut = stored(cut, "chunks")
    nodes, edges = graphs.behaviour_graph(cut, "graph", "node", "action", "ts", "actor")
    features = stored(graphs.graph_features(nodes, edges, "graph"), "features")
    vectors = graphs.feature_vector(features, "graph").select("graph", "features", graphs.spectral("features").alias("embedding"))
    about = cut.groupBy("graph", "dataset", "chunk").agg(
        F.count("*").alias("event_count"), F.when(F.max(F.coalesce("bad", F.lit(False))), F.max("kind")).otherwise(F.lit(BENIGN)).alias("threat_class"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
    )
    sizes = features.select("graph", F.col("edge_count").cast("long").alias("edge_count"))
    out = about.join(sizes, "graph").join(vectors, "graph").drop("graph")
    return out.withColumns({"source": F.lit(SOURCE), "confidence": F.lit(CONFIDENCE)})
