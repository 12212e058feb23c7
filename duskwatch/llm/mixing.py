"""Mixing sources to target weights by hash-random order and distributed prefix sums of sizes.

Every document gets a random key from its id and a seed. Within a source, documents are ordered by that
key. The key space of a source is cut into ranges of about ``ROWS_PER_RANGE`` documents, which is even
because keys are hashes, so a hot source spreads over many tasks. Sizes are summed by range and the few range
sums are accumulated; the range that the budget ends in is sorted and adds up its own documents, which gives the
exact cut of the source. All documents before the cut in key order are taken whole, so only ids and sizes are
shuffled and texts stay where they are. A budget above the source's size repeats the same order for further epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, stored

#: Weights of the sources by code point, repeating, null last.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
ROWS_PER_RANGE = 4096
SEED = 17
#: Up to so many sources their targets are worked out on the driver, beyond it by aggregates of a table of sources.
DRIVER_SOURCES = 100_000
#: Up to so many sources the table of sources is broadcast.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs outside space and the control characters 9 to 13; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], share: float, most: float) -> list[float]:
    """Words for each source: by weight, no more than ``most`` times its size; the excess goes to the others."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, size in enumerate(sizes) if size > 0]
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = most * sizes[i] if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _many_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """The table of sources with their targets for any number of sources, as in targets(), from a few sums at a time."""
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = stored(ordered.select("source", "size", "n", F.monotonically_increasing_id().alias("at")), "sources")
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in ordered.groupBy(part).count().collect())
    before = [sum(n for _, n in counts[:i]) for i in range(len(counts))]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for (p, _), b in zip(counts, before) for x in (p, b)]), part)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((start + F.col("at") - F.shiftleft(part, 33)) % len(weights) + 1).cast("int"))
    table = stored(ordered.select("source", F.col("size").alias("source_size"), "n", weight.alias("weight"), (most * F.col("size")).alias("limit")), "weighted")
    every = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    unit, before = 0.0, None
    while unit != before:
        full = F.col("limit") < unit * F.col("weight")
        left, weighed = table.filter("source_size > 0").agg(every - F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        before, unit = unit, max(left, 0.0) / weighed if weighed else float("inf")
    target = F.least("limit", unit * F.col("weight")) if unit != float("inf") else F.col("limit")
    return table.select("source", "source_size", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"), F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_PER_RANGE)).alias("ranges"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MAX_EPOCHS,
    seed: int = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, and the ``carry`` columns as a struct ``carried``.

    ``taken`` counts the words that the mix takes of the row, repeats counted; by source it adds up to the
    target rounded down. Sources take the weights in code point order, null being a source of its own at the
    end; null texts have size 0 and give nothing; null ids are ordered like any other value; rows that repeat
    an id share its key and are taken one after the other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).alias("key"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("print"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
    )
    slim = stored(rows.select("doc_id", "source", "size", "key"), "sizes")
    totals = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = totals.limit(DRIVER_SOURCES + 1).collect()
    if len(found) <= DRIVER_SOURCES:
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
        wanted = targets([float(r["size"]) for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
        table = spark.createDataFrame(
            [(r["source"], r["size"], t, max(1, -(-r["n"] // ROWS_PER_RANGE))) for r, t in zip(found, wanted, strict=True)],
            "source string, source_size long, target double, ranges long",
        )
    else:
        table = _many_targets(totals, weights, share, most)
    budget = F.floor("target")
    table = table.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    table = table.withColumn("rest", budget - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "of")

    def sized(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if len(found) <= BROADCAST_SOURCES else small

    bounds = stored(sized(table).join(_cuts(slim, sized(table)), F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"), "cuts")
    drop(slim)
    placed = rows.join(sized(bounds), F.col("source").eqNullSafe(F.col("of")))
    at, cut = F.struct("key", "doc_id", "size"), F.struct("cut_key", "cut_id", "cut_size")
    after = F.col("rest") - F.col("cut_start")

    def taken(part: Column) -> Column:
        return (F.col("whole") * F.col("size") + part).cast("long").alias("taken")

    columns = ["doc_id", "source", "size", "source_size", "target"]
    further = ["carried"] if carry else []
    part = F.when(at < cut, F.col("size")).when(at == cut, after).otherwise(0)
    tied = F.coalesce((F.col("ties") > 1) & (at == cut), F.lit(False))
    if bounds.filter("ties > 1").isEmpty():
        return placed.select(*columns, taken(part), *further)
    place = F.row_number().over(Window.partitionBy("source").orderBy("print")) - 1
    share_of_tie = F.greatest(F.lit(0), F.least(F.col("size"), after - place * F.col("size")))
    one_by_one = placed.filter(tied).select(*columns, taken(share_of_tie), *further)
    return placed.filter(~tied).select(*columns, taken(part), *further).unionByName(one_by_one)


def _cuts(slim: DataFrame, table: DataFrame) -> DataFrame:
    """Where each source's rest ends: key, id and size of the row there, the words before it, and how many rows tie with it."""
    unit = F.shiftrightunsigned("key", 33) / F.lit(float(1 << 31))
    ranged = slim.join(table, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.floor(unit * F.col("ranges")))
    before = Window.partitionBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("of", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(before.orderBy("range")), F.lit(0)))
    held = (F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("words"))
    ends = sums.filter(held).select(F.col("of").alias("s"), F.col("range").alias("r"), "start")
    inside = ranged.join(ends, F.col("of").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = inside.groupBy("of", "key", "doc_id", "size").agg(F.count("*").alias("ties"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    inside = inside.withColumn("words", F.col("size") * F.col("ties"))
    inside = inside.withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(before.orderBy("key", "doc_id", "size")), F.lit(0)))
    return inside.filter(held).select(
        F.col("of").alias("cut_of"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.col("start").alias("cut_start"), "ties"
    )
