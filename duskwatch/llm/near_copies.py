"""Near copies by SimHash and a complete prefix filter, verified: one document of each group stays.

Texts with the same multiset of word shingles are one class, linked to its smallest id; one document of each class
goes on. Two kinds of candidates follow, all verified by exact multiset Jaccard similarity.

The first kind is fast and joins most groups: the SimHash operator over whole documents and, because a few edits move
a 64-bit fingerprint by more bits than an index can search at scale, SimHashes of segments: shingle hashes that end in
zero bits cut a document at content-defined places. Each document is paired with the smallest and the largest id that
share a segment.

The second kind is complete for the rest. Shingles are put in one order for all documents, frequent ones last. The
first shingle in this order that two documents share, at places i and j (from 0) of a and b shingles, leaves them at
most min(a - i, b - j) in common, and a similarity of s takes s / (1 + s) * (a + b). So every similar pair shares a
shingle within the first (1 - s) * size + 1 of each, where this bound holds. Only shingles that several documents
hold there go on. Pairs of one group are never formed: in each of ``STAR_TURNS`` turns a shingle pairs one document of each
group with one of its largest group, which joins groups of copies by a number of pairs in proportion to their
documents; the pairs of documents that are in different groups even then are all compared. Before such a pair is formed, the
counts of its shingles by ``BUCKETS`` buckets bound what the two can have in common: the lesser counts add up to that at least.
Only rows that have a partner by their places get these counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import drop, release, slices, small_batches, stored, whole_runs
from .simhash import SEED, simhash_components

WORDS, SIMILARITY = 5, 0.8
#: A segment ends at one of 2 ** CUT_BITS shingles on average.
CUT_BITS = 4
#: The share of a document's segments that a candidate of the first kind must hold; pairs below it are left to the second kind.
SHARE = 0.25
#: Documents read to see which shingles are frequent, and so many frequent ones at most. They set the order only: any order finds all pairs.
ORDER_DOCS, FREQUENT, LEAST_FREQUENT = 20_000, 100_000, 3
#: Turns in which a shingle pairs groups, not documents.
STAR_TURNS = 2
#: Buckets of shingles by which pairs are bounded. A bucket that holds 255 or more counts as unlimited.
BUCKETS = 256
#: Pairs of a run that are compared at once, and those whose buckets are.
_PAIRS, _BUCKET_PAIRS = 1 << 20, 1 << 15
#: Runs of up to so many rows are compared together with others.
_SHORT = 64


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    data = (text or "").encode().lower().split()
    if not data:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*[data[i:] for i in range(words)])) if len(data) > words else [b" ".join(data)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def segment_prints(hashes: np.ndarray) -> np.ndarray:
    """Distinct SimHashes of the segments of a document."""
    if not len(hashes):
        return np.empty(0, np.int64)
    cuts = np.flatnonzero(hashes >> np.uint64(64 - CUT_BITS) == 0) + 1
    starts = np.unique(np.append(0, cuts[cuts < len(hashes)]))
    sizes = np.diff(np.append(starts, len(hashes)))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32) * 2 > sizes[:, None]
    return np.unique(np.packbits(ones, axis=1, bitorder="little").view(np.int64).ravel())


def elements(hashes: np.ndarray) -> np.ndarray:
    """Distinct values for a multiset: the first of equal hashes stays, further ones depend on their number as well."""
    ordered = np.sort(hashes)
    if not len(ordered):
        return ordered
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    number = (np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))).astype(np.uint64)
    mixed = (ordered ^ (number * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return np.where(number == 0, ordered, mixed ^ (mixed >> np.uint64(32)))


def prefix(values: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first elements in the common order, frequent ones last: so many that similar documents share one of them."""
    if not len(values):
        return values.view(np.int64)
    rank = np.zeros(len(values), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        rank = np.where(frequent[at] == values, counts[at], 0)
    order = np.lexsort((values, rank))
    return values[order[: int((1 - similarity) * len(values) + 1e-6) + 1]].view(np.int64)


def bucket_counts(values: np.ndarray) -> bytes:
    return np.minimum(np.bincount((values % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def _most_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No less than the elements that two documents share, from rows of bucket counts."""
    least = np.minimum(a, b)
    return np.where((least == 255).any(axis=1), np.iinfo(np.int64).max, least.sum(axis=1, dtype=np.int64))


def _content(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(np.sort(hashes).tobytes())


def _sampled(words: int):
    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            values = [elements(shingle_hashes(t, words)).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.int64()))], names=["elements"])

    return sampled


def _prints(words: int, similarity: float, order: Broadcast):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = order.value
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            values = [elements(h) for h in found]
            lists = [[segment_prints(h) for h in found], [prefix(v, frequent, counts, similarity) for v in values]]
            columns = [batch.column(0), pa.array(map(_content, found), pa.binary()), pa.array(map(len, found), pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in lists)]
            columns.append(pa.array(map(bucket_counts, values), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "n", "segments", "prefix", "buckets"])

    return prints


def far_pairs(root: np.ndarray, size: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs, of different groups, where the places of the shared element allow the similarity.

    Short runs are compared together, neighbours at one distance at a time; a long run by itself, its largest group on one side only.
    """
    need, n, left = similarity / (1 + similarity), ends - starts, size - place

    def fitting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = (root[a] != root[b]) & (np.minimum(left[a], left[b]) >= need * (size[a] + size[b]) - 1e-6)
        return a[keep], b[keep]

    last, at = np.repeat(np.where(n <= _SHORT, ends, 0), n), np.arange(ends[-1])
    for step in range(1, _SHORT):
        at = at[at + step < last[at]]
        if not len(at):
            break
        yield fitting(at, at + step)
    for s, e in zip(starts[n > _SHORT], ends[n > _SHORT]):
        groups, group, count = np.unique(root[s:e], return_inverse=True, return_counts=True)
        rest, rows = s + np.flatnonzero(group != count.argmax()), np.arange(s, e)
        step = max(1, _PAIRS // len(rows))
        for i in range(0, len(rest), step):
            part = rest[i : i + step]
            yield fitting(np.repeat(part, len(rows)), np.tile(rows, len(part)))


def run_pairs(root: np.ndarray, doc: np.ndarray, n_place: np.ndarray, buckets: np.ndarray, starts: np.ndarray, ends: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs of the documents of a run, from different groups, where the bounds allow the similarity."""
    size, place = n_place >> 32, n_place & 0xFFFFFFFF
    for a, b in far_pairs(root, size, place, starts, ends, similarity):
        for j in range(0, len(a), _BUCKET_PAIRS):
            u, v = a[j : j + _BUCKET_PAIRS], b[j : j + _BUCKET_PAIRS]
            fits = _most_shared(buckets[u], buckets[v]) >= similarity / (1 + similarity) * (size[u] + size[v]) - 1e-6
            if fits.any():
                yield np.sort(np.stack([doc[u[fits]], doc[v[fits]]], axis=1), axis=1)


def star_pairs(root: np.ndarray, doc: np.ndarray, n_place: np.ndarray, starts: np.ndarray, ends: np.ndarray, similarity: float, turn: int) -> Iterator[np.ndarray]:
    """In each run one document of each group with one of the largest group, where the bound allows the similarity; turns take other documents."""
    size, place = n_place >> 32, n_place & 0xFFFFFFFF
    run = np.repeat(np.arange(len(starts)), ends - starts)
    order = np.lexsort((doc if turn % 2 == 0 else -doc, root, run))
    change = (run[order][1:] != run[order][:-1]) | (root[order][1:] != root[order][:-1])
    first = np.append(0, np.flatnonzero(change) + 1)
    one, of, n = order[first], run[order[first]], np.diff(np.append(first, len(order)))
    largest = np.lexsort((-n, of))
    hub = one[largest[np.append(True, of[1:] != of[:-1])]][of]
    most = np.minimum((size - place)[one], (size - place)[hub])
    far = (one != hub) & (most >= similarity / (1 + similarity) * (size[one] + size[hub]) - 1e-6)
    if far.any():
        yield np.sort(np.stack([doc[one[far]], doc[hub[far]]], axis=1), axis=1)


def _shared_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by element, of elements that several documents hold."""
    names = ("element", "doc_id", "n_place")
    for rows, starts, ends in whole_runs(batches, names, keys=1):
        sizes = ends - starts
        held = np.repeat(sizes > 1, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(x[: ends[-1]][held]) for x in rows], names=list(names))


def _several_groups(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns, root first, without the runs of a single group, and where the runs left start and end."""
    root, n = columns[0][: ends[-1]], ends - starts
    several = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
    ends_left = np.cumsum(n[several])
    return [x[: ends[-1]][np.repeat(several, n)] for x in columns], ends_left - n[several], ends_left


def _open_rows(similarity: float):
    """The rows, sorted by element, that have a partner in another group where the places allow the similarity."""
    names = ("element", "root", "doc_id", "n_place")

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_runs(batches, names, keys=1):
            (root, element, doc, n_place), starts, ends = _several_groups([rows[1], rows[0], *rows[2:]], starts, ends)
            if not len(starts):
                continue
            met = np.zeros(len(root), bool)
            for a, b in far_pairs(root, n_place >> 32, n_place & 0xFFFFFFFF, starts, ends, similarity):
                met[a] = met[b] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[met]) for x in (element, root, doc, n_place)], names=list(names))

    return open_rows


def _runs(similarity: float, turn: int | None):
    """Rows sorted by element to the pairs of each run; all pairs of different groups without a turn."""
    names = ("element", "root", "doc_id", "n_place", *(["buckets"] if turn is None else []))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in whole_runs(batches, names, keys=1):
            columns, starts, ends = _several_groups(list(rows[1:]), starts, ends)
            if not len(starts):
                continue
            found, held = [], 0
            for new in run_pairs(*columns, starts, ends, similarity) if turn is None else star_pairs(*columns, starts, ends, similarity, turn):
                found.append(new)
                held += len(new)
                if held > _PAIRS:
                    yield _pair_batch(found)
                    found, held = [], 0
            if found:
                yield _pair_batch(found)

    return pairs


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], names=["doc_id", "other"])


def _similar(words: int, least: float):
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other_text, other = None, Counter()
        for batch in (part for whole in batches for part in slices(whole, 3)):
            u, v = [], []
            for a, b, mine, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text != other_text:
                    other_text, other = text, Counter(shingle_hashes(text, words).tolist())
                own = Counter(shingle_hashes(mine, words).tolist())
                both = sum((own & other).values())
                if both >= least * (own.total() + other.total() - both):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return similar


def _order(base: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements that many documents of a bounded sample hold, sorted, and how many."""
    share = min(1.0, ORDER_DOCS / max(base.count(), 1))
    chosen = base.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(share * (1 << 20))).select("text")
    sample = chosen.mapInArrow(_sampled(words), "elements array<long>")
    counts = sample.select(F.explode("elements").alias("element")).groupBy("element").count().filter(F.col("count") >= LEAST_FREQUENT)
    best = counts.orderBy(F.desc("count"), "element").limit(FREQUENT).toArrow()
    values, n = best.column("element").to_numpy().view(np.uint64), best.column("count").to_numpy()
    order = np.argsort(values)
    return values[order], n[order]


def _verified(base: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs that are similar. Only the texts of paired documents are joined to pairs."""
    ids = stored(pairs.select("doc_id").unionByName(pairs.select(F.col("other").alias("doc_id"))).distinct(), "paired")
    texts = stored(base.join(ids, "doc_id", "left_semi"), "texts")
    own = texts.join(pairs, "doc_id").withColumnRenamed("text", "mine")
    both = own.join(texts.select(F.col("doc_id").alias("other"), "text"), "other").select("doc_id", "other", "mine", "text")
    found = stored(both.mapInArrow(_similar(words, similarity), "u long, v long"), "similar")
    drop(texts)
    return found


def _segment_pairs(kept: DataFrame) -> DataFrame:
    parts = kept.select("doc_id", F.size("segments").alias("n"), F.explode("segments").alias("segment"))
    ends = parts.groupBy("segment").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    ends = stored(ends, "segment_ends")  # so that the join may split a segment that very many documents share
    met = parts.join(ends, "segment")
    pairs = met.select("doc_id", "n", F.col("least").alias("other")).unionByName(met.select("doc_id", "n", F.col("most").alias("other")))
    pairs = pairs.filter("doc_id <> other").groupBy("doc_id", "other").agg(F.count("*").alias("held"), F.max("n").alias("n"))
    return pairs.filter(F.col("held") >= SHARE * F.col("n")).select("doc_id", "other")


def _prefix_pairs(shared: DataFrame, buckets: DataFrame, roots: DataFrame, similarity: float, turn: int | None) -> DataFrame:
    """Pairs that may be similar and aren't in one group yet."""
    moved = roots.filter("id <> root").select(F.col("id").alias("doc_id"), "root")
    rows = shared.join(moved, "doc_id", "left").select("element", F.coalesce("root", "doc_id").alias("root"), "doc_id", "n_place")
    if turn is None:
        sides = rows.repartition("element").sortWithinPartitions("element").mapInArrow(_open_rows(similarity), "element long, root long, doc_id long, n_place long")
        rows = stored(sides, "open").join(buckets, "doc_id").select(*rows.columns, "buckets")
    return rows.repartition("element").sortWithinPartitions("element").mapInArrow(_runs(similarity, turn), "doc_id long, other long").distinct()


def near_copy_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (u, v) between ids of near copies, enough to connect their groups: no similar pair is left in two groups."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null")
    order = spark.sparkContext.broadcast(_order(base, words))
    found = base.mapInArrow(_prints(words, similarity, order), "doc_id long, content binary, n int, segments array<long>, prefix array<long>, buckets binary")
    found = stored(found, "prints")
    least = stored(found.groupBy("content").agg(F.min("doc_id").alias("least")), "contents")
    copies = stored(found.select("doc_id", "content").join(least, "content").select(F.col("doc_id").alias("u"), F.col("least").alias("v")), "copies")
    ids = stored(copies.filter("u = v").select(F.col("u").alias("doc_id")).distinct(), "classes")
    kept = found.join(ids, "doc_id", "left_semi")
    rows = kept.select("doc_id", F.shiftleft(F.col("n").cast("long"), 32).alias("n"), F.posexplode("prefix").alias("place", "element"))
    rows = rows.select("element", "doc_id", F.col("n").bitwiseOR(F.col("place").cast("long")).alias("n_place"))
    shared = rows.repartition("element").sortWithinPartitions("element").mapInArrow(_shared_elements, "element long, doc_id long, n_place long")
    shared = stored(shared, "shared_elements")
    buckets = stored(kept.select("doc_id", "buckets").join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "buckets")
    release(spark)
    whole = simhash_components(base, words=words).filter("doc_id <> component_id").select("doc_id", F.col("component_id").alias("other"))
    pairs = stored(_segment_pairs(kept).unionByName(whole.join(ids, "doc_id", "left_semi")).distinct(), "pairs")
    drop(found)
    links = _verified(base, pairs, words, similarity)
    for turn in (*range(STAR_TURNS), None):
        roots = components(links)
        pairs = stored(_prefix_pairs(shared, buckets, roots, similarity, turn), "pairs")
        links = stored(roots.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(_verified(base, pairs, words, similarity)), "links")
        release(spark)
    drop(shared)
    drop(buckets)
    return copies.filter("u <> v").unionByName(links)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: of each group of linked documents the rows with the smallest id stay.

    Links have a multiset Jaccard similarity of at least ``similarity`` over word shingles, lower-cased A-Z. All
    columns are kept. Texts without words, null or empty, are near copies of each other. Rows with a null id
    stay; rows that repeat an id stay or go together. An empty table gives an empty result.
    """
    roots = components(near_copy_links(docs, id_col, text_col, words, similarity))
    gone = roots.filter("id <> root").select(F.col("id").alias("gone"))
    return docs.join(gone, docs[f"`{id_col}`"] == gone["gone"], "left_anti")
