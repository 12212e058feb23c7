"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash triggers on the smallest hashed gram among the first ``WINDOW`` gram positions of a string; the
trigger depends on the string alone. Triggers cut every text into phrases: a phrase holds the starts that share
one trigger, so the bytes from its first start to the trigger are a word of the dictionary, and what follows from the
trigger is a suffix of the parse, cut where the last string of the phrase ends. A string is a suffix of the word
and the beginning of the parse suffix, and equal strings have equal triggers at equal places.

1. The parse: one row per phrase, named by rolling hashes. Parse suffixes that share their first
   ``length - window + 1`` bytes (core) with no other one can hold no repeated string and go. A core whose phrases
   are all equal holds only repeated ones.
2. Of the other phrases each different one is opened once, with the number of its copies, and put in the order of
   its parse suffix: consecutive ranges of the suffix array of the parse, one core being one run of rows.
3. Within a run, the words are sorted from their ends, with the lengths of common ends: each suffix of a dictionary
   word is an interval of that order, so this is the suffix array of the dictionary by groups of equal suffixes.
   Parse suffixes are sorted, with the lengths of common beginnings.
4. Both combine into corpus order: for each length ``a`` of a word's suffix, starts are ordered by (equal suffixes of
   ``a`` bytes, rank of the parse suffix). A string is repeated if a neighbour in this order agrees in
   ``length - a`` bytes of the parse suffix, or if its phrase has copies.

Phrases stand for all their copies, so groups of copies of any size are counted before the shuffle and opened once.
A core with more than ``CORE_CLASSES`` different phrases is too large for a task; its strings are named by
128-bit hashes and counted with partial sums. Names are 128-bit polynomial hashes, cores 64 bits, where a clash only
opens more phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, release, slices, small_batches, stored

LENGTH = 400
GRAM = 32
WINDOW = 128
#: Different phrases of one core that a task puts in order together, and phrases that it works on at once.
CORE_CLASSES, PHRASES_AT_ONCE = 2_000, 8_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Rolling:
    """Polynomial prefix hashes over 64-bit words; any substring's hash takes two look-ups."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self.letter = _mix(np.arange(1, 257, dtype=np.uint64) * _U(seed))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            for name, value in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, value)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(n, dtype=np.uint64)
        np.cumsum(self.letter[data] * self.powers[: n - 1], dtype=np.uint64, out=out[1:])
        return out

    def names(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((prefix[end] - prefix[start]) * self.inverses[start])


_FIRST = Rolling(0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SECOND = Rolling(0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)


def _sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    """Position of the least of each ``window`` neighbours, the last one of equals."""
    best = np.arange(len(values), dtype=np.int32)
    span = 1
    while span < window:
        step = min(span, window - span)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        span += step
    return best


def phrases(data: bytes, length: int, gram: int, window: int) -> dict[str, np.ndarray]:
    """First start, shape (trigger - low, high - low in 16 bits each), core and extent names of every phrase of a text."""
    letters = np.frombuffer(data, dtype=np.uint8)
    starts = len(letters) - length + 1
    if starts < 1:
        return {}
    first, second = _FIRST.prefix(letters), _SECOND.prefix(letters)
    at = np.arange(starts + window - 1)
    trigger = _sliding_least(_FIRST.names(first, at, at + gram), window)
    low = np.flatnonzero(np.append(True, trigger[1:] != trigger[:-1]))
    high = np.append(low[1:], starts) - 1
    trigger = trigger[low].astype(np.int64)
    core_end = trigger + length - window + 1
    return {
        "low": low,
        "shape": (trigger - low) * 65536 + high - low,
        "core": _FIRST.names(first, trigger, core_end),
        "name1": _FIRST.names(first, low, high + length),
        "name2": _SECOND.names(second, low, high + length) ^ _mix(((trigger - low) * 65536 + high - low).astype(np.uint64)),
    }


PHRASES = "doc_id {id}, mark long, low int, shape int, core long, name1 long, name2 long"


def _parse(length: int, gram: int, window: int, id_type: pa.DataType):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            parts, n = [], 0
            ids, marks, data = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            for i in range(len(batch)):
                found = phrases(data[i].as_py(), length, gram, window)
                if found:
                    parts.append((i, found))
                    n += len(found["low"])
                if n > 200_000:
                    yield rows(parts, ids, marks)
                    parts, n = [], 0
            if parts:
                yield rows(parts, ids, marks)

    def rows(parts, ids, marks) -> pa.RecordBatch:
        of = np.repeat([i for i, _ in parts], [len(p["low"]) for _, p in parts])
        column = lambda k, t: pa.array(np.concatenate([p[k] for _, p in parts]).astype(np.uint64).view(np.int64).astype(t))
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(of)).cast(id_type), pa.array(marks[of]), column("low", np.int32), column("shape", np.int32)]
            + [column(k, np.int64) for k in ("core", "name1", "name2")],
            names=["doc_id", "mark", "low", "shape", "core", "name1", "name2"],
        )

    return parse


OPENED = "core long, class long, n long, shape int, data binary"


def _open(length: int):
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the phrases asked for: (core, class, copies of the phrase, shape, bytes that its strings cover)."""
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in (part for whole in batches for part in slices(whole, 0)):
            rows = [
                (w["core"], w["class"], w["n"], w["shape"], data[w["low"] : w["low"] + (w["shape"] & 65535) + length])
                for data, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for w in asked
            ]
            for at in range(0, len(rows), 20_000):
                columns = zip(*rows[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["core", "class", "n", "shape", "data"])

    return opened


def _sorted(run: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by (run, bytes) and how many bytes each has in common with the row before; -1 in another run."""
    key = np.concatenate([run.astype(">u4").view(np.uint8).reshape(-1, 4), strings], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    inside = strings[order]
    apart = inside[1:] != inside[:-1]
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), strings.shape[1])
    common[run[order][1:] != run[order][:-1]] = -1
    return order, np.append(-1, common)


def _least_tables(values: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... neighbours, for minima of any range by two look-ups."""
    tables, span = [values], 1
    while 2 * span <= len(values):
        tables.append(np.minimum(tables[-1][:-span], tables[-1][span:]))
        span *= 2
    return tables


def corpus_order(run: np.ndarray, copies: np.ndarray, shape: np.ndarray, data: list[bytes], length: int) -> np.ndarray:
    """Of phrases, grouped by ``run``: whether the string that starts ``a`` bytes before the trigger is repeated, by (phrase, a).

    Strings are repeated if they stand in two phrases of a run, or in one that has copies.
    """
    back, low_a = (shape >> 16).astype(np.int64), (shape >> 16).astype(np.int64) - (shape & 65535)
    width = int(back.max(initial=0)) + 1
    ends = np.cumsum([len(d) for d in data])
    starts = ends - [len(d) for d in data]
    flat = np.frombuffer(b"".join(data), np.uint8)
    at = starts[:, None] + back[:, None] - 1 - np.arange(width)
    words = np.where(at >= starts[:, None], flat[np.maximum(at, 0)], 0).astype(np.uint8)
    at = starts[:, None] + back[:, None] + np.arange(length)
    follow = np.where(at < ends[:, None], flat[np.minimum(at, len(flat) - 1)], 0).astype(np.uint8)
    by_word, same_end = _sorted(run, words)
    by_follow, same_begin = _sorted(run, follow)
    rank = np.empty(len(run), np.int64)
    rank[by_follow] = np.arange(len(run))
    least = _least_tables(same_begin)
    valid_from, valid_to, word_rank = low_a[by_word], back[by_word], rank[by_word]
    out = np.zeros((len(run), width), bool)
    for a in range(width):
        own = np.flatnonzero((valid_from <= a) & (a <= valid_to))
        suffix = np.cumsum(same_end < a)[own]
        order = np.argsort(suffix * len(run) + word_rank[own])
        suffix, place, phrase = suffix[order], word_rank[own][order], by_word[own][order]
        if len(order) > 1:
            step = np.frexp(place[1:] - place[:-1])[1] - 1
            near = suffix[1:] == suffix[:-1]
            first, last, step = place[:-1][near] + 1, place[1:][near], step[near]
            common = np.empty(len(first), np.int64)
            for k in np.unique(step):
                of = step == k
                common[of] = np.minimum(least[k][first[of]], least[k][last[of] - (1 << int(k)) + 1])
            again = np.flatnonzero(near)[common >= length - a]
            out[phrase[again], a] = out[phrase[again + 1], a] = True
        several = phrase[copies[phrase] > 1]
        out[several, a] = True
    return out


HITS = "class long, runs array<struct<a: int, b: int>>"


def _repeated_runs(rows: list[tuple], run: list[int], length: int) -> pa.RecordBatch:
    _, number, copies, shape, data = zip(*rows)
    number, shape = np.array(number), np.array(shape)
    found = corpus_order(np.array(run), np.array(copies), shape, list(data), length)
    back = shape >> 16
    edge = np.zeros((len(number), 1), np.int8)
    change = np.diff(np.concatenate([edge, found[:, ::-1].astype(np.int8), edge], axis=1), axis=1)
    at, a = np.nonzero(change == 1)
    _, b = np.nonzero(change == -1)
    shift = back[at] - found.shape[1] + 1
    cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    runs = pa.StructArray.from_arrays([pa.array((x + shift).astype(np.int32)) for x in (a, b - 1)], names=["a", "b"])
    offsets = pa.array(np.append(cuts, len(at)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(number[at[cuts]]), pa.ListArray.from_arrays(offsets, runs)], names=["class", "runs"])


def _within_cores(length: int, core_bytes: int):
    """Runs of repeated starts of each class, from rows in the order of their parse suffixes; a core may span batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        run: list[int] = []
        before = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                back = row[3] >> 16
                core = row[4][back : back + core_bytes]
                if core != before and len(rows) >= PHRASES_AT_ONCE:
                    yield _repeated_runs(rows, run, length)
                    rows, run = [], []
                run.append((run[-1] + (core != before)) if run else 0)
                rows.append(row)
                before = core
        if rows:
            yield _repeated_runs(rows, run, length)

    return each


def _strings(rows: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """class, offset, copies and both names of every string of (core, class, copies, shape, data) rows."""
    parts = []
    for _, number, n, _, data in rows:
        letters = np.frombuffer(data, dtype=np.uint8)
        at = np.arange(len(letters) - length + 1)
        names = [r.names(r.prefix(letters), at, at + length) for r in (_FIRST, _SECOND)]
        parts.append((np.full(len(at), number), at.astype(np.int32), np.full(len(at), n), *names))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _one_by_one(length: int):
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for at in range(0, len(rows), 500):
                columns = _strings(rows[at : at + 500], length)
                arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["class", "off", "n", "name1", "name2"])

    return strings


def cut(data: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What stays of ``data`` and the maximal removed runs, from spans of repeated starts (low, high)."""
    runs: list[list[int]] = []
    for low, high in sorted(spans):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high + length)
        else:
            runs.append([low, high + length])
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), [(a, b) for a, b in runs]


def _cut_all(length: int, schema: pa.Schema):
    def remove_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for data, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = data.as_py()
                kept, runs = cut(data, [(s["low"], s["high"]) for s in spans or ()], length)
                out.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in runs]))
            columns = [pa.array(x, type=f.type) for x, f in zip(zip(*out), list(schema)[1:])] if out else [pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(schema[0].type), *columns], schema=schema)

    return remove_spans


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    window: int = WINDOW,
    with_text: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) and spans if wanted.

    Removes each byte that a string of ``length`` bytes covers which also starts anywhere else, in another row
    or the same one; strings lie within one text and are judged on the input. Null and empty texts stay empty.
    Rows that repeat are each other's copies, so all their strings are removed. Null ids are kept as they are.
    An empty table gives an empty result. Other columns are ignored. ``gram + window`` may not exceed ``length``.
    """
    if gram + window > length:
        raise ValueError("gram + window may not exceed length")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("mark"), F.encode(text, "UTF-8").alias("data"))
    kind = base.schema["doc_id"].dataType
    arrow_kind = _arrow(kind)
    parsed = base.filter(F.octet_length("data") >= length).mapInArrow(_parse(length, gram, window, arrow_kind), PHRASES.format(id=kind.simpleString()))
    parsed = stored(parsed, "phrases")
    cores = parsed.groupBy("core").agg(F.count("*").alias("n"), F.min("name1").alias("least"), F.max("name1").alias("most"))
    # stored, so that the join below is free to split a core that very many phrases share
    again = stored(cores.filter("n > 1").select("core", (F.col("least") == F.col("most")).alias("alike")), "cores")
    shared = stored(parsed.join(again, "core"), "shared_phrases")
    drop(parsed)
    keys = ["core", "name1", "name2"]
    classes = shared.filter("not alike").groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark", "low", "shape")).alias("one")
    )
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    wanted = F.struct("core", "class", "n", "one.low", "one.shape")
    asked = classes.groupBy(F.col("one.doc_id").alias("doc_id"), F.col("one.mark").alias("mark")).agg(F.collect_list(wanted).alias("asked"))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.mark") == F.col("b.mark")]
    sources = base.alias("a").join(asked.alias("b"), same).select("data", "asked")
    opened = stored(sources.mapInArrow(_open(length), OPENED), "opened")
    release(spark)
    hits = stored(_repeated(opened, classes, length, length - window + 1), "hits")
    drop(opened)
    found = stored(classes.join(hits, "class").select(*keys, "runs"), "found")
    high = F.col("low") + F.col("shape").bitwiseAND(65535)
    whole = shared.filter("alike").select("doc_id", "mark", "low", high.alias("high"))
    part = shared.filter("not alike").join(found, keys).select("doc_id", "mark", "low", F.explode("runs").alias("r"))
    part = part.select("doc_id", "mark", (F.col("low") + F.col("r.a")).alias("low"), (F.col("low") + F.col("r.b")).alias("high"))
    spans = whole.unionByName(part).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = stored(spans, "spans")
    drop(shared)
    joined = base.alias("a").join(spans.alias("b"), same, "left").select("a.doc_id", "a.data", "b.spans")
    schema = pa.schema(
        [("doc_id", arrow_kind), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
         ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    )
    out = joined.mapInArrow(
        _cut_all(length, schema),
        f"doc_id {kind.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>",
    )
    return out if with_text else out.drop("kept", "spans")


def _repeated(opened: DataFrame, classes: DataFrame, length: int, core_bytes: int) -> DataFrame:
    """(class, runs): the runs of offsets, from the first start of the phrase, at which a repeated string starts."""
    sizes = classes.groupBy("core").agg(F.count("*").alias("m"))
    large = stored(sizes.filter(F.col("m") > CORE_CLASSES).select("core"), "large_cores")
    opened = opened.dropDuplicates(["class"]) if _repeats_rows(classes, opened) else opened
    few, many = opened, None
    if not large.isEmpty():
        few, many = opened.join(large, "core", "left_anti"), opened.join(large, "core", "left_semi")
    core = F.substring("data", F.shiftright("shape", 16) + 1, F.lit(core_bytes))
    runs = few.repartitionByRange(core).sortWithinPartitions(core)
    hits = runs.mapInArrow(_within_cores(length, core_bytes), HITS)
    if many is None:
        return hits
    strings = many.mapInArrow(_one_by_one(length), "class long, off int, n long, name1 long, name2 long")
    strings = stored(strings, "strings")
    repeated = stored(strings.groupBy("name1", "name2").agg(F.sum("n").alias("times")).filter("times > 1").drop("times"), "repeated_strings")
    single = strings.join(repeated, ["name1", "name2"]).select("class", "off")
    offs = single.groupBy("class").agg(F.collect_list(F.struct(F.col("off").alias("a"), F.col("off").alias("b"))).alias("runs"))
    return hits.unionByName(offs)


def _repeats_rows(classes: DataFrame, opened: DataFrame) -> bool:
    """Whether rows that repeat a document have opened a class twice."""
    return opened.count() > classes.count()


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
