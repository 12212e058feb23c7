"""SimHash near-duplicates through a hierarchical index in Gray order.

Texts with equal fingerprints are one class, so copies cost nothing below. Two fingerprints that differ in
at most ``bits`` places agree wholly on one of ``bits + 1`` blocks of bits, and on one of as many parts of
what remains. These shared patterns are the top nodes of the index: a fingerprint goes to each node that it
can meet a partner in, and a node is one run of rows. Within a run, fingerprints are sorted by Gray rank and
grouped; each group stores the bits that all its members share. Two groups whose shared bits already differ in
more than ``bits`` places are dropped whole, otherwise their children are compared, down to fingerprints.
A run gives a spanning forest of its links, never all pairs, and components() joins the forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import components
from .shared import small_batches, stored, whole_runs

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
FANOUT = 32
_SLICE = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles, lower-cased A-Z, as a signed integer; 0 without words."""
    data = (text or "").encode().lower().split()
    if not data:
        return 0
    shingles = map(b" ".join, zip(*[data[i:] for i in range(words)])) if len(data) > words else [b" ".join(data)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int32)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(words: int = SHINGLE_WORDS):
    @F.pandas_udf(LongType())
    def simhash(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in text], dtype="int64")

    return simhash


def node_masks(bits: int, depth: int = 2) -> list[int]:
    """Bit patterns of the top nodes: blocks of the 64 bits, and by depth blocks of what remains, as signed masks."""

    def split(free: list[int], level: int) -> list[int]:
        if not level:
            return [0]
        parts = [list(p) for p in np.array_split(free, bits + 1)]
        out = []
        for part in parts:
            own = sum(1 << int(b) for b in part)
            out += [own | below for below in split([b for b in free if b not in part], level - 1)]
        return out

    masks = sorted(set(split(list(range(64)), depth)))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _levels(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask of shared bits) of each level from fingerprints in Gray order up to one short list."""
    levels = [(prints, np.full(len(prints), ~np.uint64(0)))]
    while len(levels[-1][0]) > FANOUT:
        pattern, mask = levels[-1]
        starts = np.arange(0, len(pattern), FANOUT)
        first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
        shared = ~np.bitwise_or.reduceat(pattern ^ first | ~mask, starts)
        levels.append((pattern[starts] & shared, shared))
    return levels


def close_pairs(prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs a < b of distinct fingerprints in Gray order that differ in at most ``bits`` places."""
    levels = _levels(prints)

    def search(level: int, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits
        a, b = a[near], b[near]
        if level == 0:
            yield a, b
            return
        size, step = len(levels[level - 1][0]), np.arange(FANOUT)
        for at in range(0, len(a), 1024):
            x = (a[at : at + 1024, None] * FANOUT + step)[:, :, None]
            y = (b[at : at + 1024, None] * FANOUT + step)[:, None, :]
            x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
            keep = (x < size) & (y < size) & ((x < y) if level == 1 else (x <= y))
            yield from search(level - 1, x[keep], y[keep])

    top = np.arange(len(levels[-1][0]))
    a, b = (z.ravel() for z in np.meshgrid(top, top, indexing="ij"))
    keep = (a < b) if len(levels) == 1 else (a <= b)
    yield from search(len(levels) - 1, a[keep], b[keep])


def _forest(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from each fingerprint to the root of its group in this run."""
    root = np.arange(len(prints))
    for a, b in close_pairs(prints, bits):
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root[root], root):
                root = root[root]
    linked = root != np.arange(len(prints))
    return prints[linked], prints[root[linked]]


def _run_links(bits: int):
    """Rows sorted by (node, pattern, rank) to the links of each run; a run may span batches."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, prints), starts, ends in whole_runs(batches, ("node", "pattern", "print"), keys=2):
            several = ends - starts > 1
            found = [_forest(prints[s:e].view(np.uint64), bits) for s, e in zip(starts[several], ends[several])]
            if found:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return links


def hamming_links(classes: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """From distinct fingerprints (print) to links (u, v) that connect all within ``bits`` places."""
    masks = node_masks(bits)
    nodes = F.array(*[F.struct(F.lit(i).cast("long").alias("node"), F.col("print").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(masks)])
    rank = F.col("print")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    routed = classes.select("print", rank.alias("rank")).select("print", "rank", F.explode(nodes).alias("n"))
    routed = routed.select("n.node", "n.pattern", "print", "rank")
    spread = routed.repartition("node", "pattern")
    ordered = spread.sortWithinPartitions("node", "pattern", "rank").select("node", "pattern", "print")
    return ordered.mapInArrow(_run_links(bits), "u long, v long").distinct()


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, class_size.

    component_id is the smallest id reachable over links of at most ``bits`` differing bits, itself included.
    Null, empty and blank texts have fingerprint 0 and are linked like any other. Rows that repeat an id each
    give a row; a null id is never a component_id unless all ids of the component are null. An empty table
    gives an empty result. Other input columns are ignored.
    """
    small_batches(docs.sparkSession)
    prints = docs.select(F.col(f"`{id_col}`").alias("doc_id"), fingerprint_column(words)(F.col(f"`{text_col}`")).alias("print"))
    prints = stored(prints, "fingerprints")
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(hamming_links(classes.select("print"), bits))
    rooted = classes.join(roots.withColumnRenamed("id", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    rooted = stored(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(ids, "root").select("print", "component_id", F.col("n").alias("class_size"))
    out = prints.join(table, "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "class_size")
