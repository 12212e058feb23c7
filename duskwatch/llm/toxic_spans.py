"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given by document only, so token labels are derived first: features (a word, its prefixes)
that stand in toxic training documents and hardly in others are markers, and a token with a marker in
a toxic document is labelled toxic. The field has two states and is trained by maximum likelihood on these
tokens. Scoring runs forward-backward over every token of every text, each text being one chain of any length;
marginals give spans, and a logistic model over their largest and their sum gives the document score.

Long chains are worked on in segments of ``SEGMENT`` tokens side by side: the transfer matrix of each segment is
multiplied out first, which gives the forward and backward message at every cut. The result is that of one pass.

Fitting reads at most ``FIT_DOCS`` labelled documents, the ones with the smallest hash of their id, and the
field and the document model are trained on at most ``TRAIN_DOCS`` of them, which are gathered on the driver as integers,
about 30 bytes a word. Whole texts are read in fitting as in scoring, which covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches

FIT_DOCS = 12_000
TRAIN_DOCS = 3_000
#: Tokens of training documents that are worked on at once; a longer document is one such piece by itself.
PIECE_TOKENS = 200_000
SLOTS = 1 << 18
#: Tokens of a segment, and segments that are worked on together.
SEGMENT, SEGMENTS_AT_ONCE = 256, 4096
PREFIXES = (3, 4, 5, 6, 7, 8)
CACHE_WORDS = 150_000
#: A marker stands in so many toxic documents at least, and in this share of them, and so much likelier than in clean ones.
MIN_TOXIC, MIN_TOXIC_SHARE, MIN_ODDS = 4, 0.008, 25.0
EPOCHS, RATE, DECAY = 6, 0.5, 1e-6
_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """A lower-cased word and its prefixes by length."""
    return [word, *(f"{n}^{word[:n]}" for n in PREFIXES if len(word) > n)]


def _slots(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(f.encode()) % SLOTS for f in features(word)]


@dataclass
class ToxicModel:
    """Feature weights, the 2 x 2 transition weights, the start weights, and the logistic model of documents."""

    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    document: np.ndarray

    def emission(self, word: str) -> float:
        return float(self.weights[_slots(word)].sum())


def _segments(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, end and number within its text of the segments of texts that end at ``ends``."""
    starts = np.append(0, ends[:-1]).astype(np.int64)
    counts = -(-(ends - starts) // SEGMENT)
    text = np.repeat(np.arange(len(ends)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[text] + within * SEGMENT
    return first, np.minimum(first + SEGMENT, ends[text]), within


def _columns(scores: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors exp(score) by (position, segment), longest segments first, and how many segments reach each position."""
    width = int((last - first).max())
    at = np.minimum(first + np.arange(width)[:, None], last - 1)
    return np.exp(np.clip(scores[at], -30, 30)), np.count_nonzero(first + np.arange(width)[:, None] < last, axis=1)


def _transfer(e: np.ndarray, live: np.ndarray, begins: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From either state before a segment (at its first token if it begins a text) to states 0 and 1 of its last token."""
    zero = np.where(begins, np.array([[1.0], [0.0]]), move[:, :1])
    one = np.where(begins, np.array([[0.0], [1.0]]), move[:, 1:] * e[0])
    for t in range(1, len(e)):
        k = live[t]
        x, y = zero[:, :k], one[:, :k]
        to_zero, to_one = x * move[0, 0] + y * move[1, 0], (x * move[0, 1] + y * move[1, 1]) * e[t, :k]
        total = to_zero.sum(0) + to_one.sum(0)
        zero[:, :k], one[:, :k] = to_zero / total, to_one / total
    return zero, one


def chain_marginals(scores: np.ndarray, ends: np.ndarray, transition: np.ndarray, start: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 of all tokens of texts that end at ``ends``, and the marginals of neighbours summed (2, 2)."""
    out, pairs = np.zeros(len(scores)), np.zeros((2, 2))
    first, last, within = _segments(ends)
    move, begin = np.exp(transition), float(np.exp(start[1] - start[0]))
    begins, goes_on = within == 0, np.append(within[1:] > 0, False)
    into, beyond = np.ones(len(first)), np.ones(len(first))
    order = np.argsort(first - last, kind="stable")
    linked = order[(~begins | goes_on)[order]]
    if len(linked):
        zero, one = np.zeros((2, len(first))), np.zeros((2, len(first)))
        for i in range(0, len(linked), SEGMENTS_AT_ONCE):
            of = linked[i : i + SEGMENTS_AT_ONCE]
            zero[:, of], one[:, of] = _transfer(*_columns(scores, first[of], last[of]), begins[of], move)
        weight = begin * np.exp(np.clip(scores[first], -30, 30))
        by_number = np.argsort(within, kind="stable")
        levels = np.split(by_number, np.cumsum(np.bincount(within))[:-1])
        for of, after in zip(levels, levels[1:]):
            c = np.where(begins[after - 1], weight[after - 1], into[after - 1])
            into[after] = (one[0, after - 1] + c * one[1, after - 1]) / (zero[0, after - 1] + c * zero[1, after - 1])
        for of in levels[:0:-1]:
            beyond[of - 1] = (zero[1, of] + one[1, of] * beyond[of]) / (zero[0, of] + one[0, of] * beyond[of])
    for i in range(0, len(order), SEGMENTS_AT_ONCE):
        of = order[i : i + SEGMENTS_AT_ONCE]
        e, live = _columns(scores, first[of], last[of])
        forward, backward = np.zeros_like(e), np.ones_like(e)
        before = into[of]
        forward[0] = np.where(begins[of], begin * e[0], e[0] * (move[0, 1] + move[1, 1] * before) / (move[0, 0] + move[1, 0] * before))
        for t in range(1, len(e)):
            r = forward[t - 1, : live[t]]
            forward[t, : live[t]] = e[t, : live[t]] * (move[0, 1] + move[1, 1] * r) / (move[0, 0] + move[1, 0] * r)
        b = beyond[of]
        for t in range(len(e) - 1, -1, -1):
            k = live[t]
            backward[t, :k] = b[:k]
            if t:
                x = e[t, :k] * b[:k]
                b[:k] = (move[1, 0] + move[1, 1] * x) / (move[0, 0] + move[0, 1] * x)
        held = np.arange(len(of)) < live[:, None]
        odds = forward * backward
        at = first[of] + np.arange(len(e))[:, None]
        out[at[held]] = (odds / (1 + odds))[held]
        if with_pairs:
            r = np.concatenate([before[None], forward[:-1]])
            held[0] &= ~begins[of]
            r, x = r[held], (e * backward)[held]
            total = move[0, 0] + move[0, 1] * x + r * (move[1, 0] + move[1, 1] * x)
            pairs += np.array([[(move[0, 0] / total).sum(), (move[0, 1] * x / total).sum()], [(move[1, 0] * r / total).sum(), (move[1, 1] * r * x / total).sum()]])
    return out, pairs


def _batch_marginals(model: ToxicModel, texts: list[str | None], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens of the texts, and the token where each text ends."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = [x for w in words for x in w]
    fresh = {x: model.emission(x) for x in set(flat).difference(cache)}
    cache.update(fresh)
    scores = np.fromiter(map(cache.__getitem__, flat), np.float64, len(flat))
    if len(cache) > CACHE_WORDS:
        for x in fresh:
            del cache[x]
    return chain_marginals(scores, ends, model.transition, model.start)[0], ends


def _summary(marginals: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By document: 1, log-odds of its largest marginal, log of their sum."""
    n = len(ends)
    most, total = np.zeros(n), np.zeros(n)
    starts = np.append(0, ends[:-1])
    full = ends > starts
    if full.any():
        most[full] = np.maximum.reduceat(marginals, starts[full])
        total[full] = np.add.reduceat(marginals, starts[full])
    p = np.clip(most, 1e-4, 1 - 1e-4)
    return np.stack([np.ones(n), np.log(p / (1 - p)), np.log(total + 1e-2)], axis=1)


_caches: dict[str, dict[str, float]] = {}


def _score(shared, key: str, id_type: pa.DataType, with_spans: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if key not in _caches:  # a worker that goes on with another model frees the last one's words
            _caches.clear()
        cache = _caches.setdefault(key, {})
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                marginals, ends = _batch_marginals(model, texts, cache)
                p = 1 / (1 + np.exp(-(_summary(marginals, ends) @ model.document)))
                spans = [_spans(t, marginals[b - n : b]) if with_spans else None for t, b, n in zip(texts, ends, np.diff(np.append(0, ends)))]
                kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(id_type), pa.array(p), pa.array(spans, kinds)], names=["doc_id", "score", "spans"])

    return score


def _spans(text: str | None, marginals: np.ndarray) -> list[dict]:
    """Character offsets of runs of tokens whose marginal is a half or more, with the largest of the run."""
    if not (marginals >= 0.5).any():
        return []
    lowered = (text or "").lower()
    source = text if len(lowered) == len(text or "") else lowered
    out: list[dict] = []
    for i, m in enumerate(_WORD.finditer(source)):
        if i < len(marginals) and marginals[i] >= 0.5:
            if out and out[-1]["last"] == i - 1:
                out[-1] |= {"end": m.end(), "score": max(out[-1]["score"], float(marginals[i])), "last": i}
            else:
                out.append({"start": m.start(), "end": m.end(), "score": float(marginals[i]), "last": i})
    return [{k: s[k] for k in ("start", "end", "score")} for s in out]


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()

    def flush():
        names = list(toxic.keys() | clean.keys())
        for at in range(0, len(names), 20_000):
            part = names[at : at + 20_000]
            counts = [pa.array([c[n] for n in part], pa.int64()) for c in (toxic, clean)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], names=["feature", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}
            (toxic if label else clean).update(found)
            if len(toxic) + len(clean) > 150_000:
                yield from flush()
                toxic, clean = Counter(), Counter()
    yield from flush()


def _train_rows(markers: frozenset[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall((text or "").lower())
                slots = [_slots(w) for w in words]
                tags = bytes(int(bool(label) and not markers.isdisjoint(features(w))) for w in words)
                sizes, flat = (np.array(x, "<i4").tobytes() for x in ([len(s) for s in slots], [x for s in slots for x in s]))
                yield pa.RecordBatch.from_pydict({"label": pa.array([label], pa.int32()), "sizes": [sizes], "slots": [flat], "tags": [tags]})

    return rows


def _pieces(docs: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes, slots, tags and document ends of runs of documents with at most ``PIECE_TOKENS`` tokens, one document at least."""
    at = 0
    while at < len(docs):
        to, held = at + 1, len(docs[at][2])
        while to < len(docs) and held + len(docs[to][2]) <= PIECE_TOKENS:
            held += len(docs[to][2])
            to += 1
        part, at = docs[at:to], to
        yield (*(np.concatenate([d[k] for d in part]) for k in range(3)), np.cumsum([len(d[2]) for d in part]))


def _train(rows: list, markers_found: bool, odds: float = 1.0) -> ToxicModel:
    """Adaptive gradient ascent on the likelihood of the tags, then the logistic model of the document labels.

    ``odds`` are those of the label over all labelled documents; the training documents are balanced.
    """
    model = ToxicModel(np.zeros(SLOTS), np.zeros((2, 2)), np.zeros(2), np.array([-4.0, 0.5, 0.0]))
    if not rows or not markers_found:
        return model
    docs = [(np.frombuffer(r["sizes"], "<i4"), np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["tags"], np.uint8), r["label"]) for r in rows if len(r["tags"])]
    order = np.random.default_rng(7)
    seen, seen_move, seen_start = np.full(SLOTS, 1e-2), np.full((2, 2), 1e-2), np.full(2, 1e-2)
    for _ in range(EPOCHS):
        mixed = order.permutation(len(docs))
        for i in range(0, len(docs), 150):
            change = gradient(model, [docs[j] for j in mixed[i : i + 150]])
            for value, change, square in zip((model.weights, model.transition, model.start), change, (seen, seen_move, seen_start)):
                square += change**2
                value += RATE * change / np.sqrt(square)
    _fit_documents(model, docs, odds)
    return model


def gradient(model: ToxicModel, docs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of the tags, less the decay of the weights: by weights, transitions and start weights."""
    slope, move, first = -DECAY * model.weights * len(docs), np.zeros((2, 2)), np.zeros(2)
    for sizes, slots, tags, ends in _pieces(docs):
        token = np.repeat(np.arange(len(sizes)), sizes)
        scores = np.bincount(token, model.weights[slots], len(sizes))
        expected, pairs = chain_marginals(scores, ends, model.transition, model.start, with_pairs=True)
        slope += np.bincount(slots, (tags - expected)[token], SLOTS)
        inner = np.ones(len(tags), bool)
        starts = np.append(0, ends[:-1])
        inner[starts] = False
        at = np.flatnonzero(inner)
        move += np.bincount(tags[at - 1] * 2 + tags[at], minlength=4).reshape(2, 2) - pairs
        first += np.bincount(tags[starts], minlength=2) - np.array([(1 - expected[starts]).sum(), expected[starts].sum()])
    return slope, move, first


def _fit_documents(model: ToxicModel, docs: list, odds: float) -> None:
    sums = []
    for sizes, slots, _, ends in _pieces(docs):
        scores = np.bincount(np.repeat(np.arange(len(sizes)), sizes), model.weights[slots], len(sizes))
        sums.append(_summary(chain_marginals(scores, ends, model.transition, model.start)[0], ends))
    x, y = np.concatenate(sums), np.array([d[3] for d in docs], float)
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2]) * len(y)
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - np.array([1e-3, 1e-2, 1e-2]) * len(y) * w)
    model.document = w + np.array([np.log(odds * max((1 - y).sum(), 1) / max(y.sum(), 1)), 0.0, 0.0])


def fit_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
              fit_docs: int = FIT_DOCS, train_docs: int = TRAIN_DOCS) -> ToxicModel:
    """Fit on documents that ``labels`` marks; null labels, and labels without a document, are left out.

    Of each label at most half of ``fit_docs`` and ``train_docs`` documents are taken, those with the smallest
    hash of the id. Without toxic or without clean documents every text gets the same low score.
    """
    small_batches(docs.sparkSession)
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("label in (0, 1)")
    order = marked.select("doc_id", "label", F.xxhash64("doc_id").alias("key"))
    chosen = [order.filter(F.col("label") == y).orderBy("key", "doc_id").limit(fit_docs // 2) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "key", "label", "text").persist()
    try:
        n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(n) < 2:
            return _train([], False)
        counts = rows.select("text", "label").mapInArrow(_feature_counts, "feature string, toxic long, clean long")
        counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        odds = ((F.col("toxic") + 0.1) / (n[1] + 0.2)) / ((F.col("clean") + 0.1) / (n[0] + 0.2))
        best = counts.filter(F.col("toxic") >= max(MIN_TOXIC, MIN_TOXIC_SHARE * n[1])).filter(odds >= MIN_ODDS)
        markers = frozenset(r["feature"] for r in best.select("feature").collect())
        parts = [chosen.filter(F.col("label") == y).orderBy("key", "doc_id").limit(train_docs // 2).select("doc_id") for y in (0, 1)]
        train = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id", "left_semi").select("text", "label").mapInArrow(_train_rows(markers), "label int, sizes binary, slots binary, tags binary")
        every = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
        return _train(train.collect(), bool(markers), every[1] / every[0])
    finally:
        rows.unpersist()


def score_toxic(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """One row per input row: doc_id, score from 0 to 1, and spans of offending characters with their marginals.

    Null and empty texts, and texts without words, have no spans and the score of a document without toxic
    tokens. Null and repeated ids are kept; an empty table gives an empty result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = xxhash.xxh64_hexdigest(model.weights.tobytes() + model.transition.tobytes())
    return base.mapInArrow(
        _score(shared, key, to_arrow_type(kind), with_spans), f"doc_id {kind.simpleString()}, score double, spans array<struct<start: int, end: int, score: double>>"
    )
