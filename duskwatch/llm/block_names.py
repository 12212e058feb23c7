"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered, so
equal blocks and only they have equal integer names. Adjacent names are paired and the distinct pairs are
sorted and numbered again, until each text has one name. Texts are equal exactly if they have as many
blocks and the same name.

Blocks are sorted by a 64-bit fingerprint first and by content where fingerprints tie. Their content is
shuffled once, after each task has dropped its own repeats; all that follows moves integers. Where two
contents share a fingerprint, which the first step proves or rules out, their content decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lower_ascii, only, stored

BLOCK_BYTES = 8192


def _blocks(data: Column, block_bytes: int) -> Column:
    last = F.greatest(F.lit(0), F.ceil(F.octet_length(data) / F.lit(block_bytes)).cast("int") - 1)
    at = F.sequence(F.lit(0), last)
    return F.transform(at, lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys in sorted order with increasing integers, stored so that they stay as they are."""
    ordered = rows.select(*keys).distinct().orderBy(*keys)
    return stored(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def block_name_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_blocks, block_name.

    Texts count as equal when identical after lower-casing A-Z only. Of equal texts the row with the largest
    id stays; of rows that repeat that id, one. Null texts count as empty, so null and empty texts form one
    group. A null id is smaller than any other; a group of null ids has a null keep_id. Other input columns
    are ignored. An empty table gives an empty result. ``hash_bits`` below 64 makes fingerprints collide and
    serves the tests.
    """
    base = only(docs, doc_id=id_col, text=text_col)
    data = base.select("doc_id", F.encode(lower_ascii(F.col("text")), "UTF-8").alias("data"))
    mask = F.lit((1 << (hash_bits - 1)) - 1) if hash_bits < 64 else F.lit(-1)

    def fingerprint(block: Column) -> Column:
        return F.xxhash64(block).bitwiseAND(mask)

    rows = stored(
        data.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.sha2("data", 256).alias("text_sha256"),
            F.transform(_blocks(F.col("data"), block_bytes), fingerprint).alias("prints"),
        ),
        "rows",
    )
    content = data.select(F.explode(_blocks(F.col("data"), block_bytes)).alias("block"))
    distinct = content.select(fingerprint(F.col("block")).alias("print"), "block").distinct()
    prints = stored(distinct.groupBy("print").agg(F.count("*").alias("contents")), "prints")
    names = _numbered(prints.filter("contents = 1"), "print")
    level = rows.select("uid", F.size("prints").alias("n"), F.posexplode("prints").alias("at", "print"))
    named = level.join(names, "print").select("uid", "n", "at", "name")
    tied = prints.filter("contents > 1").select("print")
    if not tied.isEmpty():
        named = named.unionByName(_named_by_content(data, rows, tied, block_bytes, fingerprint))
    return _grouped(rows, _paired(named))


def _named_by_content(data, rows, tied, block_bytes, fingerprint) -> DataFrame:
    """Names of blocks whose fingerprint several contents share: negative integers by order of content."""
    blocks = data.select(
        "doc_id", F.sha2("data", 256).alias("text_sha256"), F.posexplode(_blocks(F.col("data"), block_bytes)).alias("at", "block")
    ).withColumn("print", fingerprint(F.col("block")))
    blocks = blocks.join(tied, "print", "left_semi")
    names = _numbered(blocks, "print", "block").withColumn("name", -F.col("name") - 2)
    blocks = blocks.join(names, ["print", "block"]).select("doc_id", "text_sha256", "at", "name").distinct()
    same = rows["doc_id"].eqNullSafe(blocks["doc_id"]) & (rows["text_sha256"] == blocks["text_sha256"])
    return rows.join(blocks, same).select("uid", F.size("prints").alias("n"), "at", "name")


def _paired(named: DataFrame) -> DataFrame:
    """Name pairs of names, level by level; a text leaves at the level at which it has one name."""
    done, height = named.filter("n = 1").select("uid", F.lit(0).alias("height"), "name"), 0
    named = stored(named.filter("n > 1"), "level")
    while not named.isEmpty():
        height += 1
        side = lambda bit: F.max(F.when(F.col("at") % 2 == bit, F.col("name")))
        pairs = stored(
            named.groupBy("uid", F.floor(F.col("at") / 2).alias("at"), F.ceil(F.col("n") / 2).alias("n")).agg(
                side(0).alias("left"), F.coalesce(side(1), F.lit(-1)).alias("right")
            ),
            "pairs",
        )
        names = _numbered(pairs, "left", "right")
        above = pairs.join(names, ["left", "right"]).select("uid", "n", "at", "name")
        done = done.unionByName(above.filter("n = 1").select("uid", F.lit(height).alias("height"), "name"))
        named = stored(above.filter("n > 1"), "level")
    return done


def _grouped(rows: DataFrame, identity: DataFrame) -> DataFrame:
    slim = rows.select("uid", "doc_id", "text_sha256", F.size("prints").alias("n_blocks"))
    named = stored(slim.join(identity, "uid"), "identities")
    groups = named.groupBy("height", "name", "n_blocks").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("best")
    )
    groups = stored(groups, "groups")  # so that the join may split a large group
    return named.join(groups, ["height", "name", "n_blocks"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.uid") == F.col("uid")).alias("kept"),
        "text_sha256",
        "n_blocks",
        F.col("name").alias("block_name"),
    )
