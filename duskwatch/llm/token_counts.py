"""Token counts by a two-tier look-up on the map side, without a shuffle.

First tier: a broadcast table from frequent units to their token counts, fitted on a bounded sample of rows;
its size is bounded by ``TABLE_UNITS``. Second tier: each worker's own cache, behind which misses are encoded.
The sample only decides what is quick: counts are exact for any table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches
from .tokenizing import encoder, vocabulary

#: Rows that the table of frequent units is fitted on, and the most units it holds.
SAMPLE_ROWS = 2_000
TABLE_UNITS = 50_000
MAX_TOKENS = 1024


def _frequent(path: str, most: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update((text or "").split(" ")[1:])
        encode = encoder(path)
        top = sorted((u for u, n in seen.items() if n > 1), key=lambda u: (-seen[u], u))[:most]
        sizes = [len(encode.unit(u)) // encode.dtype.itemsize for u in top]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(sizes, pa.int32())], names=["unit", "n"])

    return count


def _count(path: str, table):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first_tier = encoder(path), table.value
        width = encode.dtype.itemsize
        for batch in (part for whole in batches for part in slices(whole, 1)):
            texts = batch.column(1)
            numbers, starts, units, firsts = encode.split(texts)
            known = map(first_tier.get, units)
            size = [n if n is not None else len(encode.unit(u)) // width for n, u in zip(known, units, strict=True)]
            size += [len(firsts[i]) // width for i in range(len(texts) - 1, -1, -1)]
            tokens = np.add.reduceat(np.array(size, dtype=np.int64)[numbers], starts[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    max_tokens: int = MAX_TOKENS,
    sample_rows: int = SAMPLE_ROWS,
    table_units: int = TABLE_UNITS,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens above ``max_tokens``).

    Null and empty texts have 0 bytes and tokens. Special strings in a text are what the library makes of them
    by default. Null and repeated ids are kept as they are, an empty table gives an empty result, and other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = vocabulary_path or vocabulary()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    share = min(1.0, 1.5 * sample_rows / max(1, base.count()))
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(float(1 << 31))
    sample = base.filter(key <= share).select("text").limit(sample_rows).coalesce(1)
    top = sample.mapInArrow(_frequent(path, table_units), "unit string, n int").collect()
    table = docs.sparkSession.sparkContext.broadcast({r.unit: r.n for r in top})
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.mapInArrow(_count(path, table), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
