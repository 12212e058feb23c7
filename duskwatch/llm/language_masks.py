"""Language identification by n-gram filters whose rows are language bitmasks.

A bit-sliced Bloom filter holds one bit per language in each row. One look-up of an n-gram ands its rows and
returns all languages that may hold it. The set bits are counted per language over all n-grams of a text, the
expected number of false positives is taken off, and the language with the largest corrected share wins.

A row has one 64-bit word for every 64 languages.

The filter is fitted on about ``FIT_DOCS`` documents of each language, those whose hashed id lies below the
share that gives as many; its size is fixed. Prediction covers all rows and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, small_batches

FIT_DOCS = 1_500
GRAM = 4
ROWS = 1 << 21
HASHES = 3
#: An n-gram is kept for a language if so many of its documents hold it, and this share of the most common holder's.
MIN_DOCS = 3
MIN_SHARE = 0.2
#: Letters of a text that are hashed at once.
LETTERS_AT_ONCE = 1 << 20
_NO_LETTER = re.compile(r"[\W\d_]+")
_U = np.uint64
_SPREAD = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of the letter n-grams of a text, in runs: lower case, words parted by single spaces, also around."""
    letters = _NO_LETTER.sub(" ", (text or "").lower()).strip(" ")
    if not letters:
        return
    letters = f"  {letters}  "
    for at in range(0, len(letters) - GRAM + 1, LETTERS_AT_ONCE):
        points = np.frombuffer(letters[at : at + LETTERS_AT_ONCE + GRAM - 1].encode("utf-32-le"), np.uint32).astype(np.uint64)
        out = np.zeros(len(points) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            out = out * _U(0x2545F4914F6CDD1D) + points[i : i + len(out)]
        yield out ^ (out >> _U(32))


def _rows(hashes: np.ndarray) -> list[np.ndarray]:
    return [((hashes * s) >> _U(40)).astype(np.int64) % ROWS for s in _SPREAD[:HASHES]]


@dataclass
class LanguageFilter:
    """languages by bit; the filter's words by (64 languages, row); by language the rate of false positives; the language to fall back on."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    common: int

    def shares(self, text: str | None) -> np.ndarray | None:
        """Corrected share of the n-grams that each language holds, or None without letters."""
        total, counts = 0, np.zeros(len(self.languages))
        for hashes in grams(text):
            total += len(hashes)
            counts += self.holders(hashes)
        if not total:
            return None
        return np.maximum(0.0, (counts - total * self.false_rate) / (1 - self.false_rate)) / total

    def holders(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language may hold: its bits in the rows' words, anded."""
        first, *others = _rows(hashes)
        n, counts = len(self.languages), []
        for word, masks in enumerate(self.masks):
            found = masks[first]
            for at in others:
                found = found & masks[at]
            bits = min(64, n - 64 * word)
            if bits <= 12:
                per_mask = np.bincount(found.astype(np.int64), minlength=1 << bits)
                counts += [per_mask[(np.arange(len(per_mask)) >> i & 1) == 1].sum() for i in range(bits)]
            else:
                counts += [np.count_nonzero(found >> _U(i) & _U(1)) for i in range(bits)]
        return np.array(counts, float)

    def predict(self, text: str | None) -> tuple[str, float]:
        shares = self.shares(text)
        if shares is None or not self.languages:
            return "und", 0.0
        total = shares.sum()
        if not total:
            return self.languages[self.common], 1 / len(self.languages)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best] / total)


def _document_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        for lang, part in frame.groupby("lang"):
            found, held = [], 0
            for text in part["text"]:
                found.append(np.unique(np.concatenate([np.empty(0, np.uint64), *map(np.unique, grams(text))])))
                held += len(found[-1])
                if held > LETTERS_AT_ONCE:
                    yield _counts(lang, found)
                    found, held = [], 0
            if held:
                yield _counts(lang, found)


def _counts(lang: str, found: list[np.ndarray]) -> pd.DataFrame:
    hashes, docs = np.unique(np.concatenate(found), return_counts=True)
    return pd.DataFrame({"lang": lang, "gram": hashes.view(np.int64), "docs": docs.astype(np.int64)})


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> LanguageFilter:
    """Fit on rows with a language. Null languages are left out; any number of languages is one bit each."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.filter("lang is not null")
    found = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    languages = [x for x, _ in found]
    if not languages:
        return LanguageFilter([], np.zeros((0, ROWS), np.uint64), np.zeros(0), 0)
    share = F.element_at(F.create_map(*[F.lit(v) for x, n in found for v in (x, min(1.0, fit_docs / n))]), F.col("lang"))
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 33) / F.lit(float(1 << 31))
    sample = rows.filter(key < share).select("lang", "text")
    counted = sample.mapInPandas(_document_grams, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    sizes = {x: min(n, fit_docs) for x, n in found}
    share = F.col("docs") / F.element_at(F.create_map(*[F.lit(v) for x in languages for v in (x, sizes[x])]), F.col("lang"))
    top = F.max("share").over(Window.partitionBy("gram"))
    kept = counted.withColumn("share", share).withColumn("top", top)
    kept = kept.filter((F.col("docs") >= F.least(F.lit(MIN_DOCS), F.lit(min(sizes.values())))) & (F.col("share") >= MIN_SHARE * F.col("top")))
    number = F.element_at(F.create_map(*[v for i, x in enumerate(languages) for v in (F.lit(x), F.lit(i))]), F.col("lang"))
    numbered = kept.select("gram", number.alias("number"))
    bits = numbered.select("gram", F.floor(F.col("number") / 64).alias("word"), F.expr("shiftleft(1L, number % 64)").alias("bit"))
    merged = bits.mapInPandas(_filter_rows, "word long, row long, bit long").groupBy("word", "row").agg(F.bit_or("bit").alias("mask"))
    filled = merged.toPandas()
    masks = np.zeros((-(-len(languages) // 64), ROWS), np.uint64)
    masks[filled["word"].to_numpy(), filled["row"].to_numpy()] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(masks[i // 64] >> _U(i % 64) & _U(1)) / ROWS for i in range(len(languages))])
    common = max(range(len(languages)), key=lambda i: (found[i][1], -i))
    return LanguageFilter(languages, masks, np.minimum(fill**HASHES, 0.999), common)


def _filter_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = _rows(frame["gram"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"word": np.tile(frame["word"].to_numpy(), HASHES), "row": np.concatenate(rows), "bit": np.tile(frame["bit"].to_numpy(), HASHES)})


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score from 0 to 1.

    A null text or one without a letter is ``und`` with score 0. A text whose n-grams no language holds gets the
    most common language of the fit with score 1 / languages. Of equal shares the first language in code point order
    wins. Null and repeated ids are kept; an empty table
    gives an empty result; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(docs.sparkSession)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = base.schema["doc_id"].dataType
    shared, id_type = docs.sparkSession.sparkContext.broadcast(model), to_arrow_type(kind)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            columns = zip(*found) if found else [(), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *arrays], names=["doc_id", "lang_pred", "score"])

    return base.mapInArrow(predict, f"doc_id {kind.simpleString()}, lang_pred string, score double")
