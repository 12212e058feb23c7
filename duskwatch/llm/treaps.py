"""Ranked search with an inverted treap for each term.

The index is cut by documents: a shard is a run of documents that one task reads, so no posting is shuffled to build it.
Within a shard the postings of a term form a treap: a search tree by document, a heap by impact. A search follows the
treaps of all its terms at once over intervals of documents. The tops of the treaps within an interval bound every
score in it: if their sum can't enter the best k, the interval and all subtrees below go unread. Else the document of the
weightiest top is scored and splits the interval.

Items go to the shards in blocks of bounded size, one after the other; the best k of every shard meet in a window whose
ranks Spark limits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import TEXT_BYTES, lower_ascii, new_path, only, slices, small_batches, stored

#: Characters of a term: ASCII letters and digits, and everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same on bytes: letters in lower case, the rest as they are, separators as spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A shard ends after so many documents or terms; a longer document is a shard by itself.
SHARD_DOCS = 16_384
SHARD_TERMS = 2_000_000
#: Terms of the items that go to every task at once; one item is the least.
BLOCK_TERMS = 200_000
#: Items followed together, and intervals that are split in one step.
_TOGETHER, _STEP = 64, 4096
_SEED = 29


@dataclass(frozen=True)
class TreapIndex:
    """``table`` holds (shard, term, df, root, docs, impacts, lefts, rights), and per shard a row without term with its ``ids`` in order."""

    table: DataFrame
    n_docs: int
    n_terms: int


def words_of(text: bytes, table: bytes, most: int = TEXT_BYTES) -> Iterator[list[bytes]]:
    """The words of a text after translation, in pieces of about ``most`` bytes."""
    data, at = text.translate(table), 0
    while at < len(data):
        end = len(data) if len(data) - at <= most else data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def grouped(texts: list[bytes], table: bytes) -> Iterator[tuple[list[list[bytes]], bool, bool]]:
    """The words of each text together; a single text comes in pieces. With it: whether it goes on from the last group, and on in the next."""
    if len(texts) > 1:
        yield [t.translate(table).split() for t in texts], False, False
        return
    pieces, goes_on = words_of(texts[0], table), False
    words = next(pieces, [])
    while words is not None:
        later = next(pieces, None)
        yield [words], goes_on, later is not None
        words, goes_on = later, True


def run_starts(texts: pa.Array, table: bytes) -> np.ndarray:
    """How many words each text has, without making them."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    inside = np.frombuffer(table, np.uint8)[data] != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1] - offsets[0]
    full = at[at < np.append(at[1:], len(data))]
    first[full] = inside[full]
    return np.diff(np.append(0, np.cumsum(first))[offsets - offsets[0]])


def coded(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """The number of each word in ``known``, which grows."""
    encoded = pa.array(words, pa.binary()).dictionary_encode()
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in encoded.dictionary.to_pylist()), np.int32, len(encoded.dictionary))
    return numbers[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)


def treaps(starts: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each list, left child, right child) for lists that begin at ``starts``; positions count from a list's start, -1: none.

    Of equal impacts the earlier is above.
    """
    values = impacts.tolist()
    left, right, roots = [-1] * len(values), [-1] * len(values), []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(values)]):
        stack: list[int] = []
        for i in range(start, end):
            x, last = values[i], -1
            while stack and values[stack[-1]] < x:
                last = stack.pop()
            if last >= 0:
                left[i] = last - start
            if stack:
                right[stack[-1]] = i - start
            stack.append(i)
        roots.append(stack[0] - start)
    return np.array(roots, np.int32), np.array(left, np.int32), np.array(right, np.int32)


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _shard(shard: int, ids: pa.Array, known: dict[bytes, int], codes: np.ndarray, rows: np.ndarray, n_docs: int, n_terms: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys, tf = np.unique(codes.astype(np.int64) * len(order) + place[rows], return_counts=True)
    term, doc = np.divmod(keys, len(order))
    length = np.bincount(place[rows], minlength=len(order)).tolist()
    m = np.array([100 - 90 + (90 * n * n_docs) // n_terms for n in length], np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    roots, left, right = treaps(starts, impact)
    names = pa.array(list(known), pa.binary()).cast(pa.string())
    n = len(starts)
    columns = [
        pa.array(np.full(n, shard)), names.take(pa.array(term[starts])), pa.array(np.diff(np.append(starts, len(doc))).astype(np.int64)), pa.array(roots),
        _lists(starts, doc), _lists(starts, impact), _lists(starts, left), _lists(starts, right), pa.nulls(n, schema.field("ids").type),
    ]
    whole = pa.RecordBatch.from_arrays(columns, schema=schema)
    for at in range(0, n, 10_000):
        yield whole.slice(at, 10_000)
    held = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids.take(pa.array(order)))
    yield pa.RecordBatch.from_arrays([pa.array([shard]), *[pa.nulls(1, schema.field(i).type) for i in range(1, 8)], held], schema=schema)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_terms: int = SHARD_TERMS) -> TreapIndex:
    """Index every row of ``docs``, stored in the shared folder.

    Null and empty texts hold no term. Null ids come last among equal scores; rows that repeat an id are documents of
    their own. Other columns are ignored. An empty table gives an empty index.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = only(docs, doc_id=id_col, text=text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            n = run_starts(batch.column(1), _BYTES)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])

    texts = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n_docs, n_terms = texts.mapInArrow(count, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    kind = rows.schema["doc_id"].dataType.simpleString()
    numbers = "docs array<int>, impacts array<int>, lefts array<int>, rights array<int>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, ids, known, codes, places, n, size = 0, [], {}, [], [], 0, 0
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            shard = (TaskContext.get().partitionId() << 32) + serial
            yield from _shard(shard, pa.concat_arrays(ids), known, np.concatenate(codes), np.concatenate(places), n_docs, n_terms, schema)

        for batch in (part for whole in batches for part in slices(whole, 1)):
            listed = pa.list_(batch.schema.field(0).type)
            ints = pa.list_(pa.int32())
            schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("root", pa.int32()), ("docs", ints), ("impacts", ints), ("lefts", ints), ("rights", ints), ("ids", listed)])
            if size and (n >= shard_docs or size + pc.sum(pc.binary_length(batch.column(1))).as_py() // 6 > shard_terms):
                yield from flush()
                serial, ids, known, codes, places, n, size = serial + 1, [], {}, [], [], 0, 0
            ids.append(batch.column(0))
            for words, _, _ in grouped(batch.column(1).to_pylist(), _BYTES):
                lengths = [len(w) for w in words]
                codes.append(coded([x for w in words for x in w], known))
                places.append(np.repeat(np.arange(n, n + len(words), dtype=np.int32), lengths))
                size += sum(lengths)
            n += len(batch)
        if size:
            yield from flush()

    table = texts.mapInArrow(build, f"shard long, term string, df long, root int, {numbers}, ids array<{kind}>")
    return TreapIndex(stored(table, "treaps"), n_docs, n_terms)


def best(roots: np.ndarray, weights: np.ndarray, size: int, doc: np.ndarray, impact: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k best (item, document, score) of each item over documents 0 to ``size`` - 1, and how many documents were scored.

    ``roots`` and ``weights`` have a row for each item and a column for each of its terms; the last node is empty.
    """
    items, width = roots.shape
    floor, floor_doc, scored = np.zeros(items, np.int64), np.full(items, -1, np.int64), 0
    top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    open_ = [(np.arange(items), np.zeros(items, np.int64), np.full(items, size, np.int64), roots)]
    while open_:
        q, lo, hi, nodes = open_.pop()
        flat, low, high = nodes.ravel().copy(), np.repeat(lo, width), np.repeat(hi, width)
        x = doc[flat]
        out = np.flatnonzero((x >= high) | ((x < low) & (x >= 0)))
        while out.size:  # down to the top of each treap within the interval
            at = flat[out]
            at = np.where(doc[at] >= high[out], left[at], right[at])
            flat[out] = at
            x = doc[at]
            out = out[(x >= high[out]) | ((x < low[out]) & (x >= 0))]
        nodes = flat.reshape(nodes.shape)
        weight = weights[q] * impact[nodes]
        bound = weight.sum(1)
        may = (bound > floor[q]) | ((bound == floor[q]) & (lo < floor_doc[q]))
        if not may.all():
            q, lo, hi, nodes, weight, bound = (v[may] for v in (q, lo, hi, nodes, weight, bound))
        if len(q) > _STEP:
            order = np.argpartition(-bound, _STEP)
            rest, order = order[_STEP:], order[:_STEP]
            open_.append((q[rest], lo[rest], hi[rest], nodes[rest]))
            q, lo, hi, nodes, weight = (v[order] for v in (q, lo, hi, nodes, weight))
        if not len(q):
            continue
        pivot = doc[nodes[np.arange(len(q)), weight.argmax(1)]]
        at, wanted = nodes.ravel().copy(), np.repeat(pivot, width)
        seek = np.flatnonzero((doc[at] != wanted) & (doc[at] >= 0))
        while seek.size:  # search for the document in every treap
            now = at[seek]
            now = np.where(doc[now] > wanted[seek], left[now], right[now])
            at[seek] = now
            seek = seek[(doc[now] != wanted[seek]) & (doc[now] >= 0)]
        score = (weights[q] * impact[at].reshape(nodes.shape)).sum(1)
        scored += len(q)
        top = tuple(np.concatenate(v) for v in zip(top, (q, pivot, score)))
        order = np.lexsort((top[1], -top[2], top[0]))
        owner = top[0][order]
        rank = np.arange(len(order)) - np.searchsorted(owner, owner)
        order = order[rank < k]
        top = tuple(v[order] for v in top)
        last = np.flatnonzero(rank[rank < k] == k - 1)
        floor[top[0][last]], floor_doc[top[0][last]] = top[2][last], top[1][last]
        q, lo, hi, nodes = np.append(q, q), np.append(lo, pivot + 1), np.append(pivot, hi), np.concatenate([nodes, nodes])
        some = lo < hi
        open_.append((q[some], lo[some], hi[some], nodes[some]))
    return *top, scored


def _joined(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _search(shared, k: int, out: pa.Schema):
    def search(shard: pa.Table) -> pa.Table:
        names, item_of, terms, weights = shared.value
        is_term = pc.is_valid(shard.column("term"))
        ids = shard.filter(pc.invert(is_term)).column("ids").combine_chunks().flatten()
        shard = shard.filter(is_term)
        nothing = out.empty_table()
        slot = pc.index_in(terms, value_set=shard.column("term").combine_chunks()).to_numpy(zero_copy_only=False) if len(shard) else np.zeros(0)
        there = np.flatnonzero(~np.isnan(slot)) if len(slot) else slot
        if not len(there):
            return nothing
        docs, sizes = _joined(shard.column("docs"))
        starts = np.cumsum(sizes) - sizes
        empty, shift = len(docs), np.repeat(starts, sizes)
        move = lambda name: np.append(np.where((c := _joined(shard.column(name))[0]) >= 0, c + shift, empty), empty)
        doc, impact = np.append(docs, -1).astype(np.int64), np.append(_joined(shard.column("impacts"))[0], 0).astype(np.int64)
        left, right, root = move("lefts"), move("rights"), starts + shard.column("root").to_numpy()
        own, node, weight = item_of[there], root[slot[there].astype(np.int64)], weights[there]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        width = np.diff(np.append(first, len(own)))
        found = []
        by_width = np.argsort(width, kind="stable")
        for at in range(0, len(first), _TOGETHER):
            group = by_width[at : at + _TOGETHER]
            roots, factors = np.full((len(group), width[group].max()), empty), np.zeros((len(group), width[group].max()), np.int64)
            for i, g in enumerate(group):
                roots[i, : width[g]], factors[i, : width[g]] = node[first[g] : first[g] + width[g]], weight[first[g] : first[g] + width[g]]
            q, d, score, _ = best(roots, factors, len(ids), doc, impact, left, right, k)
            found.append((own[first[group[q]]], d, score))
        q, d, score = (np.concatenate(v) for v in zip(*found))
        return pa.Table.from_arrays([names.take(pa.array(q)), ids.take(pa.array(d)), pa.array(score)], schema=out)

    return search


def search(index: TreapIndex, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score; equal scores by ascending doc_id, scores of 0 left out.

    Rows that repeat an item_id are one item with the terms of all of them; a null id is an item too. Null and empty
    texts find nothing. Terms count once for each item.
    """
    spark = index.table.sparkSession
    asked = only(items, item_id=item_col, text=text_col).select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    terms = index.table.filter("term is not null")
    asked = stored(asked, "asked")
    df = terms.select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    asked = stored(asked.join(df, "term").withColumn("weight", weight).filter("weight > 0"), "weights")
    kinds = {c: t.dataType.simpleString() for c, t in (("item_id", asked.schema["item_id"]), ("doc_id", index.table.schema["ids"]))}
    kinds["doc_id"] = kinds["doc_id"][len("array<") : -1]
    path, blocks = new_path(spark, "found"), max(1, -(-asked.count() // block_terms))
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64(F.lit(_SEED), F.coalesce(F.col("item_id").cast("string"), F.lit(""))), F.lit(blocks)) == block)
        rows = part.select("item_id", "term", "weight").toArrow()
        names, numbers = _numbered(rows.column("item_id"))
        order = np.argsort(numbers, kind="stable")
        shared = spark.sparkContext.broadcast((names, numbers[order], rows.column("term").combine_chunks().take(pa.array(order)), rows.column("weight").to_numpy()[order]))
        needed = terms.join(part.select("term").distinct(), "term", "left_semi").select(index.table.columns)
        schema = pa.schema([("item_id", names.type), ("doc_id", index.table.select("ids").limit(0).toArrow().schema.field(0).type.value_type), ("score", pa.int64())])
        found = needed.unionByName(index.table.filter("term is null")).groupBy("shard").applyInArrow(_search(shared, k, schema), f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long")
        found.write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long").parquet(path)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values, null included, and the number of each row's value."""
    encoded = column.combine_chunks().dictionary_encode("encode")
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
