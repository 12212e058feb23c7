"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window can only be similar to an item if they share a shingle, so windows are laid around the places where a
shingle of an item stands; all other places are left out without loss. Each window of an item's size gets the
SimHash of its shingles. The 64 bits are cut into eight blocks; fingerprints within ``radius`` bits agree
within two bits on one block at least (eight blocks with three differences make 24), so tables of block
values, each listing the items within two bits, give all of them. Candidates within the radius are then
compared by the exact weighted Jaccard similarity of their shingles, counts as weights.

Items are broadcast in blocks of at most ``ITEMS_AT_ONCE`` items and ``ITEM_BYTES`` of text, a longer item being a
block by itself; each block is one pass over the documents. The benchmark streams through the driver block by block.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
ITEMS_AT_ONCE, ITEM_BYTES = 20_000, 4 << 20
#: Windows whose fingerprints are looked up at once.
WINDOWS_AT_ONCE = 4_096
CACHE_WORDS = 100_000
_WORDS = re.compile(r"\w+")
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word.encode())
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_hashes = _WordHash()


def shingle_hashes(words: list[str], k: int) -> np.ndarray:
    """Hashes of the word k-grams in order."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _U(0x9E3779B97F4A7C15) + h[i : i + n]
    out ^= out >> _U(32)
    out *= _U(0xD6E8FEB86659FD93)
    return out ^ (out >> _U(29))


def window_prints(hashes: np.ndarray, width: int) -> np.ndarray:
    """SimHash of every run of ``width`` shingle hashes."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    ones = (sums[width:] - sums[:-width]) * 2 > width
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


class ItemIndex:
    """Items of one block: shingles to items, and fingerprints under the eight block tables."""

    def __init__(self, items: list[tuple[object, str]], k: int, similarity: float, radius: int):
        if not 0 <= radius <= 23:
            raise ValueError("eight blocks guarantee a radius of 23 at most")
        self.k, self.similarity, self.radius = k, similarity, radius
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.sizes = [min(k, len(w)) for w in self.words]
        self.grams = [Counter(zip(*(w[j:] for j in range(n)))) for w, n in zip(self.words, self.sizes)]
        prints, self.at = [], defaultdict(lambda: defaultdict(list))
        for i, (w, n) in enumerate(zip(self.words, self.sizes)):
            hashes = shingle_hashes(w, n)
            prints.append(window_prints(hashes, len(hashes))[0])
            for h in np.unique(hashes):
                self.at[n][int(h)].append(i)
        self.prints = np.array(prints, np.uint64)
        self.known = {n: np.sort(np.fromiter(at, np.uint64, len(at))) for n, at in self.at.items()}
        self.low = {}
        for n, known in self.known.items():
            self.low[n] = np.zeros(1 << 20, bool)
            self.low[n][(known & _U((1 << 20) - 1)).astype(np.int64)] = True
        value = np.arange(256, dtype=np.uint8)
        blocks = self.prints.view(np.uint8).reshape(-1, 8)
        self.near = [np.bitwise_count(value[:, None] ^ blocks[None, :, b]) <= 2 for b in range(8)] if len(self.prints) else []

    def within(self, prints: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) pairs within the radius, of the items given."""
        tables = [near[:, items] for near in self.near]
        for at in range(0, len(prints), WINDOWS_AT_ONCE):
            part = prints[at : at + WINDOWS_AT_ONCE]
            blocks = part.view(np.uint8).reshape(-1, 8)
            hit = tables[0][blocks[:, 0]]
            for b in range(1, 8):
                hit |= tables[b][blocks[:, b]]
            w, i = np.nonzero(hit)
            close = np.bitwise_count(part[w] ^ self.prints[items[i]]) <= self.radius
            yield from zip((w[close] + at).tolist(), items[i[close]].tolist())

    def matches(self, text: str | None) -> list[tuple]:
        """(item, similarity, first word, end word, windows) of each item found, by its most similar window."""
        words = words_of(text)
        found: dict[int, list] = {}
        for n, low in self.low.items():
            hashes = shingle_hashes(words, n)
            hits = np.flatnonzero(low[(hashes & _U((1 << 20) - 1)).astype(np.int64)])
            if not len(hits):
                continue
            known = self.known[n]
            place = np.minimum(np.searchsorted(known, hashes[hits]), len(known) - 1)
            hits = hits[known[place] == hashes[hits]]
            by_item = defaultdict(list)
            for p in hits.tolist():
                for i in self.at[n][int(hashes[p])]:
                    by_item[i].append(p)
            for width, group in self._by_width(by_item, n).items():
                width = min(width, len(hashes))
                starts = self._starts({p for i in group for p in by_item[i]}, width, len(hashes))
                for a, b in starts:
                    prints = window_prints(hashes[a : b + width - 1], width)
                    for w, i in self.within(prints, np.array(sorted(group))):
                        self._verify(words, a + w, width + n - 1, i, found)
        return [(self.ids[i], *best) for i, best in sorted(found.items())]

    def _by_width(self, by_item: dict[int, list[int]], n: int) -> dict[int, set[int]]:
        out = defaultdict(set)
        for i in by_item:
            out[len(self.words[i]) - n + 1].add(i)
        return out

    @staticmethod
    def _starts(hits: set[int], width: int, n: int) -> list[tuple[int, int]]:
        """Disjoint ranges (first, end) of the starts of windows that hold a hit."""
        out: list[list[int]] = []
        for p in sorted(hits):
            a, b = max(0, p - width + 1), min(p, n - width) + 1
            if b <= a:
                continue
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, b) for a, b in out]

    def _verify(self, words: list[str], start: int, size: int, item: int, found: dict[int, list]) -> None:
        window, n = words[start : start + size], self.sizes[item]
        own, other = Counter(zip(*(window[j:] for j in range(n)))), self.grams[item]
        both = sum((own & other).values())
        similarity = both / (sum(own.values()) + sum(other.values()) - both)
        if similarity >= self.similarity:
            best = found.setdefault(item, [similarity, start, start + size, 0])
            best[3] += 1
            if similarity > best[0]:
                best[:3] = [similarity, start, start + size]


def _find(items, k: int, similarity: float, radius: int, id_type: pa.DataType, item_type: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items.value, k, similarity, radius)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in index.matches(t)]
            columns = zip(*rows) if rows else [()] * 6
            kinds = (id_type, item_type, pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "first_word", "end_word", "windows"])

    return find


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, similarity, first_word, end_word, windows.

    Words are runs of letters, digits and underscores in lower case. A window has as many words as the item;
    similarity is that of its most similar window, the first of equals. An item of fewer words than a shingle is
    one shingle; an item without words, a null or an empty text matches nothing. Rows that repeat a document or
    an item give a row each; null ids are kept. Without items or documents the result is empty. Other columns
    are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    kinds = base.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, similarity double, first_word int, end_word int, windows int"
    out, block, held = None, [], 0

    def passed(block):
        found = _find(spark.sparkContext.broadcast(block), words, similarity, radius, *map(to_arrow_type, kinds))
        return base.mapInArrow(found, schema)

    for row in items.toLocalIterator():
        block.append(tuple(row))
        held += len(row["text"] or "")
        if len(block) == ITEMS_AT_ONCE or held >= ITEM_BYTES:
            out, block, held = passed(block) if out is None else out.unionByName(passed(block)), [], 0
    if block or out is None:
        out = passed(block) if out is None else out.unionByName(passed(block))
    return out
