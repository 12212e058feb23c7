"""Katz backoff language model over words, in partitioned tables.

Texts are encoded in chunks of bounded size: a dictionary of the chunk's words and the text as numbers into it. Words get
global numbers by a join on each chunk's dictionary, not on each token. A chunk then asks for its different word pairs,
sorted and packed into one row per bucket; a bucket of the table of pairs holds all pairs of its contexts, frequent
contexts being split over several. So what is shuffled is the different pairs of a chunk, not its tokens. Where a corpus is
scored that holds the training texts, the bucket that counts a chunk's pairs also answers for them.

Pairs are discounted by Good-Turing counts of counts up to ``MOST`` and, if unseen, backed off to words, whose
probabilities are add-one over all words of the training texts and one class for all others. The weight of a context makes
its probabilities sum to one exactly: what the discounts of its pairs leave, over what its unseen words have. A
context whose pairs are all too frequent for a discount keeps one count for unseen words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import drop, release, slices, small_batches, stored
from .treaps import coded, grouped

#: Letters in lower case; space and the control characters 9 to 13 as spaces.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Tokens of a chunk, and pairs of a bucket, about.
CHUNK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: A context that is more frequent than this is split over buckets.
HOT = 200_000
#: Counts up to this are discounted.
MOST = 5
#: The end of a text, and what comes before its first word. No word is empty.
END = b""


@dataclass(frozen=True)
class KatzModel:
    """``words`` holds (word, id, n, total, log_alpha), ``pairs`` (bucket, keys, counts) with keys id x n_words + id, packed."""

    words: DataFrame
    pairs: DataFrame
    n_tokens: int
    n_words: int
    buckets: int
    discounts: tuple[float, ...]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_sorted(numbers: np.ndarray) -> bytes:
    return pack(np.diff(numbers, prepend=0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def discounts(counts: list[int], most: int = MOST) -> tuple[float, ...]:
    """Good-Turing discounts of counts 1, 2, ... from the numbers of pairs with each count; none where they can't be had."""
    for k in range(min(most, len(counts) - 1), 1, -1):
        if min(counts[: k + 1]) > 0 and (k + 1) * counts[k] < counts[0]:
            rest = (k + 1) * counts[k] / counts[0]
            found = tuple(((r + 1) * counts[r] / (r * counts[r - 1]) - rest) / (1 - rest) for r in range(1, k + 1))
            if all(0 < d < 1 for d in found):
                return found
    return ()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of texts: chunk, ids, rows, sizes, firsts and train of the pieces of texts in it, codes, and its words with their counts.

    ``firsts`` is the code of what comes before a piece, counts are those of the rows that ``train`` picks, all by
    default. A text that is longer than a chunk goes on in the next one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    picked = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), picked.alias("train"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, row = TaskContext.get().partitionId() << 33, 0, 0
        ids, numbers, sizes, firsts, picks, codes, known, total = [], [], [], [], [], [], {END: 0}, 0

        def chunk() -> pa.RecordBatch:
            whole, pick = np.concatenate(codes), np.concatenate(picks)
            names = pa.array(list(known), pa.binary()).cast(pa.string())
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            counts = np.bincount(whole[np.repeat(pick, np.concatenate(sizes))], minlength=len(known))
            columns = [pa.array([part + serial]), one(pa.concat_arrays(ids)), *[one(pa.array(np.concatenate(x))) for x in (numbers, sizes, firsts, picks)], pa.array([pack(whole)], pa.binary()), one(names), one(pa.array(counts))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "rows", "sizes", "firsts", "train", "codes", "words", "counts"])

        for batch in (x for whole in batches for x in slices(whole, 1)):
            before = END
            pick = batch.column(2).to_numpy(zero_copy_only=False)
            for words, goes_on, more in grouped(batch.column(1).to_pylist(), _BYTES):
                if not more:
                    words[-1].append(END)
                for w in words[:-1]:
                    w.append(END)
                first = np.zeros(len(words), np.int64)
                first[0] = known.setdefault(before if goes_on else END, len(known))
                ids.append(batch.column(0))
                numbers.append(np.arange(part + row, part + row + len(words)))
                sizes.append(np.array([len(w) for w in words], np.int64))
                firsts.append(first)
                picks.append(pick)
                codes.append(coded([x for w in words for x in w], known))
                total, before = total + len(codes[-1]), words[-1][-1]
                if total >= chunk_tokens:
                    yield chunk()
                    serial += 1
                    ids, numbers, sizes, firsts, picks, codes, known, total = [], [], [], [], [], [], {END: 0}, 0
            row += len(batch)
        if total:
            yield chunk()

    schema = f"chunk long, ids array<{kind}>, rows array<long>, sizes array<long>, firsts array<long>, train array<boolean>, codes binary, words array<string>, counts array<long>"
    return stored(rows.mapInArrow(cut, schema), "chunks")


def _numbered(words: DataFrame) -> DataFrame:
    """Stored (word, n, id): numbers from 0 without gaps, frequent words first, by the rows of each sorted range and the ranges before it."""
    ordered = words.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    parts = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    counts = sorted(tuple(r) for r in parts.groupBy(part.alias("part")).count().collect())  # one row for each part
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    starts = parts.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "part long, before long")
    numbered = parts.withColumn("part", part).join(F.broadcast(starts), "part")
    out = stored(numbered.select("word", "n", (F.col("at") - F.shiftleft("part", 33) + F.col("before")).alias("id")), "vocabulary")
    drop(parts)
    return out


def _looked_up(chunks: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    """(of, at, columns of ``words``): one row for each word of a chunk's dictionary."""
    asked = chunks.select(F.col("chunk").alias("of"), F.posexplode("words").alias("at", "word"))
    return asked.join(words.select("word", *columns), "word", "left").select("of", "at", *columns)


def _column(table: pa.Table, name: str, order: np.ndarray, default: float) -> np.ndarray:
    values = table.column(name).to_pandas().to_numpy()[order]
    return np.where(np.isnan(values), default, values) if values.dtype.kind == "f" else values


def _tokens(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens, of what comes before each, the sizes of the pieces, and which tokens are for training."""
    codes = unpack(chunk.column("codes")[0].as_py())
    sizes, firsts, train = (chunk.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("sizes", "firsts", "train"))
    before = np.append(0, codes[:-1])
    before[np.cumsum(sizes) - sizes] = firsts
    return codes, before, sizes, np.repeat(train, sizes)


def _mixed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64)


def _bucket(v: np.ndarray, w: np.ndarray, n: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair whose context occurs ``n`` times."""
    return (_mixed(v) + _mixed(w + 1) % (n // HOT + 1)) % buckets


@dataclass(frozen=True)
class _Chunk:
    """A chunk with the numbers of its words, and its different known pairs in order of bucket and key."""

    n: np.ndarray
    order: np.ndarray
    codes: np.ndarray
    before: np.ndarray
    sizes: np.ndarray
    bucket: np.ndarray
    key: np.ndarray
    count: np.ndarray
    first: np.ndarray
    second: np.ndarray
    places: np.ndarray
    pair: np.ndarray


def _prepared(chunk: pa.Table, known: pa.Table, n_words: int, buckets: int) -> _Chunk:
    order = np.argsort(known.column("at").to_numpy(), kind="stable")
    ids, n = _column(known, "id", order, -1).astype(np.int64), _column(known, "n", order, 0).astype(np.int64)
    codes, before, sizes, train = _tokens(chunk)
    places = np.flatnonzero((ids[codes] >= 0) & (ids[before] >= 0))
    local, where = np.unique(before[places] * np.int64(len(ids)) + codes[places], return_inverse=True)
    count = np.bincount(where, train[places], len(local)).astype(np.int64)
    v, w = np.divmod(local, len(ids))
    key, bucket = ids[v] * n_words + ids[w], _bucket(ids[v], ids[w], n[v], buckets)
    by = np.lexsort((key, bucket))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    return _Chunk(n, order, codes, before, sizes, bucket[by], key[by], count[by], v[by], w[by], places, place[where])


def _by_bucket(chunk: pa.Table, bucket: np.ndarray, columns: dict[str, Callable[[slice], bytes]]) -> pa.Table:
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    cuts = [slice(a, b) for a, b in zip(starts, [*starts[1:], len(bucket)])]
    data = {"chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(cuts), pa.int64()), "bucket": pa.array(bucket[starts].astype(np.int64))}
    return pa.table(data | {name: pa.array([f(x) for x in cuts], pa.binary()) for name, f in columns.items()})


def _answers(asked: pa.Table, keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    keys, counts, out = np.append(keys, -1), np.append(counts, 0), []
    for wanted in map(unpack_sorted, asked.column("keys").to_pylist()):
        at = np.searchsorted(keys[:-1], wanted)
        out.append(pack(np.where(keys[at] == wanted, counts[at], 0)))
    return out


#: What a task needs of a chunk's text.
_TEXT = ("chunk", "sizes", "firsts", "train", "codes")
_PAIRS = "chunk long, bucket long, keys binary, counts binary, histogram array<long>, contexts binary, small binary, seen binary"


def _fit(chunks: DataFrame, most: int, bucket_tokens: int) -> tuple[KatzModel, DataFrame]:
    """The model of the training pieces of ``chunks``; with it the counts of each chunk's pairs, by bucket."""
    counted = chunks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").alias("n")).filter("n > 0")
    words = _numbered(counted.groupBy("word").agg(F.sum("n").alias("n")))
    n_tokens, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-n_tokens // bucket_tokens))
    release(chunks.sparkSession)
    looked_up = stored(_looked_up(chunks, words, "id", "n"), "looked_up")
    release(chunks.sparkSession)

    def ask(chunk: pa.Table, known: pa.Table) -> pa.Table:
        c = _prepared(chunk, known, n_words, buckets)
        return _by_bucket(chunk, c.bucket, {"keys": lambda x: pack_sorted(c.key[x]), "counts": lambda x: pack(c.count[x]), "seconds": lambda x: pack(c.n[c.second[x]])})

    def count(rows: pa.Table) -> pa.Table:
        keys, counts, seconds = (np.concatenate([f(x) for x in rows.column(c).to_pylist()]) for c, f in (("keys", unpack_sorted), ("counts", unpack), ("seconds", unpack)))
        keys, first, where = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(where, counts).astype(np.int64)
        held = total > 0  # others are of texts that aren't for training
        keys, total, seconds = keys[held], total[held], seconds[first[held]]
        context = keys // n_words
        starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        small = np.stack([add((total == r).astype(np.int64)) for r in range(1, most + 2)])
        n, blank = len(rows), [None] * len(rows)
        return pa.table({
            "chunk": pa.array([None, *rows.column("chunk").to_pylist()], pa.int64()), "bucket": pa.array([rows.column("bucket")[0].as_py()] * (n + 1), pa.int64()),
            "keys": pa.array([pack_sorted(keys), *blank], pa.binary()), "counts": pa.array([pack(total), *_answers(rows, keys, total)], pa.binary()),
            "histogram": pa.array([small.sum(1).tolist(), *blank], pa.list_(pa.int64())), "contexts": pa.array([pack_sorted(context[starts]), *blank], pa.binary()),
            "small": pa.array([pack(small.ravel()), *blank], pa.binary()), "seen": pa.array([pack(add(seconds + 1)), *blank], pa.binary()),
        })

    asked = chunks.select(*_TEXT).groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(ask, "chunk long, bucket long, keys binary, counts binary, seconds binary")
    asked = stored(asked, "asked")  # so that the shuffle of the chunks goes before that of their pairs comes
    drop(looked_up)
    both = stored(asked.groupBy("bucket").applyInArrow(count, _PAIRS), "pairs")
    drop(asked)
    table = both.filter("chunk is null")
    histogram = list(table.agg(*[F.coalesce(F.sum(F.element_at("histogram", r)), F.lit(0)) for r in range(1, most + 2)]).first())
    found = discounts(histogram, most)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            v, seen = unpack_sorted(row["contexts"]), unpack(row["seen"])
            small = unpack(row["small"]).reshape(most + 1, -1)
            lost = sum((small[r - 1] * (r * (1 - d)) for r, d in enumerate(found, 1)), np.zeros(len(v)))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(seen), pa.array(lost)], names=["id", "seen", "lost"])

    sums = table.select("contexts", "small", "seen").mapInArrow(contexts, "id long, seen long, lost double").groupBy("id").agg(F.sum("seen").alias("seen"), F.sum("lost").alias("lost"))
    total = F.col("n") + F.when(F.col("lost") > 0, 0).otherwise(1)
    left = F.when(F.col("lost") > 0, F.col("lost")).otherwise(1) / total
    free = 1 - F.col("seen") / F.lit(float(n_tokens + n_words + 1))
    weights = stored(words.join(sums, "id").select("word", "id", "n", total.cast("long").alias("total"), F.log10(left / free).alias("log_alpha")), "weights")
    drop(words)
    return KatzModel(weights, table.select("bucket", "keys", "counts"), n_tokens, n_words, buckets, found), both.filter("chunk is not null").select("chunk", "bucket", "counts")


def fit_katz(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, most: int = MOST, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> KatzModel:
    """The model of all words and pairs of words in the rows that ``train`` picks, all by default.

    Null texts count as empty, repeated rows count again.
    """
    return _fit(encode(docs, id_col, text_col, train, chunk_tokens), most, bucket_tokens)[0]


def score_katz(docs: DataFrame, model: KatzModel, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, base_score, score.

    Tokens are the words and one end. ``n_known`` counts those of the training texts, ``base_score`` sums the log10 of
    their add-one probabilities without context, ``score`` those of the model. Null texts count as empty: an end only.
    Null and repeated ids are kept as they are, other columns are ignored, an empty table gives an empty result. Without
    training texts every token has probability 1, as there is one class only.
    """
    chunks = encode(docs, id_col, text_col, None, chunk_tokens)
    looked_up = _looked_up(chunks, model.words, "id", "n")

    def ask(chunk: pa.Table, known: pa.Table) -> pa.Table:
        c = _prepared(chunk, known, model_words, buckets)
        return _by_bucket(chunk, c.bucket, {"keys": lambda x: pack_sorted(c.key[x])})

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys, counts = (f(held.column(c)[0].as_py()) if len(held) else np.zeros(0, np.int64) for c, f in (("keys", unpack_sorted), ("counts", unpack)))
        return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "counts": pa.array(_answers(asked, keys, counts), pa.binary())})

    model_words, buckets = model.n_words, model.buckets
    requests = chunks.select(*_TEXT).groupBy("chunk").cogroup(looked_up.groupBy("of")).applyInArrow(ask, "chunk long, bucket long, keys binary")
    answers = requests.groupBy("bucket").cogroup(model.pairs.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket long, counts binary")
    return _scores(chunks, model, stored(answers, "answers"))


def fit_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, chunk_tokens: int = CHUNK_TOKENS, bucket_tokens: int = BUCKET_TOKENS) -> tuple[KatzModel, DataFrame]:
    """The model of the rows that ``train`` picks, and the scores of all rows as score_katz() gives them, in one go over the texts."""
    chunks = encode(docs, id_col, text_col, train, chunk_tokens)
    model, answers = _fit(chunks, most, bucket_tokens)
    return model, _scores(chunks, model, answers)


def _scores(chunks: DataFrame, model: KatzModel, answers: DataFrame) -> DataFrame:
    n_words, buckets, whole, cut = model.n_words, model.buckets, float(model.n_tokens + model.n_words + 1), np.array([1.0, *model.discounts])
    release(chunks.sparkSession)
    looked_up = stored(_looked_up(chunks, model.words, "id", "n", "total", "log_alpha"), "looked_up")
    release(chunks.sparkSession)
    # the dictionary and the answers of a chunk travel together, as rows of two kinds
    nothing = lambda *kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds]
    replies = answers.select(F.col("chunk").alias("of"), *nothing(("at", "int"), ("id", "long"), ("n", "long"), ("total", "long"), ("log_alpha", "double")), "bucket", "counts")
    both = looked_up.select("*", *nothing(("bucket", "long"), ("counts", "binary"))).unionByName(replies)

    def evaluate(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        known, replies = rows.filter(rows.column("at").is_valid()), rows.filter(rows.column("at").is_null())
        c = _prepared(chunk, known, n_words, buckets)
        alpha, total = _column(known, "log_alpha", c.order, 0.0), _column(known, "total", c.order, 1).astype(float)
        in_order = np.argsort(replies.column("bucket").to_numpy(), kind="stable")
        blobs = replies.column("counts").to_pylist()
        times = np.concatenate([np.zeros(0, np.int64), *[unpack(blobs[i]) for i in in_order]])
        base = np.log10((c.n + 1) / whole)[c.codes]
        score = alpha[c.before] + base  # backed off, unless the pair was seen
        rate = np.where(times < len(cut), cut[np.where(times < len(cut), times, 0)], 1.0)
        direct = np.log10(np.where(times > 0, rate * times, 1.0) / total[c.first])
        hit = (times > 0)[c.pair]
        score[c.places[hit]] = direct[c.pair[hit]]
        starts = np.cumsum(c.sizes) - c.sizes
        add = lambda x: pa.array(np.add.reduceat(x, starts))
        lists = [chunk.column(x).combine_chunks().flatten() for x in ("rows", "ids")]
        return pa.table({"row": lists[0], "doc_id": lists[1], "n_tokens": pa.array(c.sizes), "n_known": add((c.n[c.codes] > 0).astype(np.int64)), "base_score": add(base), "score": add(score)})

    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    pieces = chunks.select(*_TEXT, "rows", "ids").groupBy("chunk").cogroup(both.groupBy("of")).applyInArrow(evaluate, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    return pieces.groupBy("row", "doc_id").agg(*sums).drop("row")
