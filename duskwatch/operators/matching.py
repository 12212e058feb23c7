"""Many words looked for in many texts at once.

A list of words of bounded size goes to every task as one automaton, which reads a text once whatever the number of
words. A longer list is met by an equality join: each word by its rarest run of ``GRAM`` characters, each text by its
different runs; what meets is checked. Words shorter than a run go to the automaton in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import stored

#: Characters of words that go to every task at once.
AUTOMATON_CHARS = 8_000_000
GRAM = 4
#: Characters of a word's beginning, and of texts up to which all their beginnings go to every task.
HEAD, HEAD_CHARS = 8, 200_000


def _by_automaton(texts: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    kind = dict(texts.dtypes)[key]
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if not shared.value:  # an automaton without words can't be asked
            return
        automaton = ahocorasick.Automaton()
        for i, word in enumerate(shared.value):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, line in enumerate(batch.column(1).to_pylist()):
                hits = {i for _, i in automaton.iter(line)}
                rows += [row] * len(hits)
                found += hits
            names = pa.array([shared.value[i] for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), names], names=[key, "word"])

    return texts.select(key, text).filter(F.col(text).isNotNull()).mapInArrow(match, f"`{key}` {kind}, word string")


def _grams(column: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(column) - GRAM + 1)), lambda i: F.substring(F.col(column), i, F.lit(GRAM))))


def _by_grams(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    held = stored(texts.filter(F.char_length(text) >= GRAM).select(key, text, F.explode(_grams(text)).alias("gram")).select(key, "gram"), "grams")
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = words.select("word", F.explode(_grams("word")).alias("gram")).join(often, "gram")  # a word with a run that no text has can't match
    whole = anchors.groupBy("word").agg(F.count("*").alias("there"), F.min(F.struct("n", "gram")).alias("rarest"))
    rare = whole.filter(F.col("there") == F.size(_grams("word"))).select("word", F.col("rarest.gram").alias("gram"))
    met = held.join(rare, "gram").select(key, "word")
    return met.join(texts.select(key, text), key).filter(F.contains(text, "word")).select(key, "word")


def substring_matches(texts: DataFrame, key: str, text: str, words: DataFrame, word: str, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(key, word): the different words that occur anywhere in each text; upper and lower case as they are.

    Null and empty words match nothing, null texts hold nothing. Keys name one text each. Repeated words count once.
    """
    wanted = stored(words.select(F.col(word).alias("word")).filter("word is not null and word <> ''").distinct(), "words")
    short, chars = wanted.agg(F.sum(F.when(F.char_length("word") < GRAM, F.char_length("word")).otherwise(0)), F.sum(F.char_length("word"))).first()
    if (chars or 0) <= most_chars:
        return _by_automaton(texts, key, text, [r.word for r in wanted.collect()])
    out = _by_grams(texts, key, text, wanted.filter(F.char_length("word") >= GRAM))
    blocks = -(-(short or 0) // most_chars)
    for i in range(blocks):
        block = wanted.filter((F.char_length("word") < GRAM) & (F.pmod(F.xxhash64("word"), F.lit(blocks)) == i))
        out = out.unionByName(_by_automaton(texts, key, text, [r.word for r in block.collect()]))
    return out


def possible_words(words: DataFrame, word: str, texts: DataFrame, text: str, most_chars: int = HEAD_CHARS) -> DataFrame:
    """Rows of ``words`` whose first ``HEAD`` characters, or all if fewer, occur in one of the texts; all rows beyond ``most_chars`` of texts.

    No word that occurs in a text is lost. Rows are told apart where they are read, before they are shuffled.
    """
    chars = texts.agg(F.sum(F.char_length(text))).first()[0] or 0
    if chars > most_chars:
        return words
    runs = texts.select(text, F.explode(F.sequence(F.lit(1), F.lit(HEAD))).alias("n")).filter(F.char_length(text) >= F.col("n"))
    at = F.sequence(F.lit(1), F.char_length(text) - F.col("n") + 1)
    heads = runs.select(F.explode(F.transform(at, lambda i: F.substring(F.col(text), i, F.col("n")))).alias("__head")).distinct()
    return words.join(F.broadcast(heads), F.substring(word, 1, HEAD) == F.col("__head"), "left_semi")


def either_contains(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): different values of both sides of which one occurs in the other."""
    x, y = (stored(df.select(F.col(c).alias(c)).filter(F.length(c) > 0).distinct(), "values") for df, c in ((left, a), (right, b)))
    inside = substring_matches(x.select(a, F.col(a).alias("__t")), a, "__t", y, b).select(a, F.col("word").alias(b))
    around = substring_matches(y.select(b, F.col(b).alias("__t")), b, "__t", x, a).select(F.col("word").alias(a), b)
    return inside.unionByName(around).distinct()


def first_of_each(held: DataFrame, by: str, most: int) -> DataFrame:
    """(by, pattern_id): of each value the first ``most`` different patterns by id."""
    ranked = held.select(by, "pattern_id").withColumn("__rn", F.dense_rank().over(Window.partitionBy(by).orderBy("pattern_id")))
    return ranked.filter(F.col("__rn") <= most).select(by, "pattern_id").distinct()


def first_patterns(evidence: DataFrame, key: str, held: DataFrame, most: int) -> DataFrame:
    """(key, pattern_id, rank): of each key the first ``most`` patterns, by id, that hold one of its words.

    ``evidence`` has (key, word), ``held`` (word, pattern_id). Of a word only its first ``most`` patterns can count; they are
    stored, so that few of them go to the evidence and it is not shuffled by word.
    """
    few = stored(first_of_each(held, "word", most), "few")
    found = evidence.join(few, "word").select(key, "pattern_id").distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pattern_id"))).filter(F.col("rank") <= most)


def most_alike(asked: DataFrame, rows: DataFrame, key: str, words: str, above: float, most: int) -> DataFrame:
    """(key, other, score): of each asked row the ``most`` other rows that share most of all words of both, in percent and over ``above``; ties by key.

    ``words`` holds sorted arrays of different words. Equal arrays are compared once, and of each only the first ``most`` rows
    and one more, as one may be the asked row itself, can be found. Rows without words are like none.
    """
    held = rows.filter(F.size(words) > 0).select(F.col(key).alias("other"), F.col(words).alias("w"))
    first = stored(held.withColumn("__rn", F.row_number().over(Window.partitionBy("w").orderBy("other"))).filter(F.col("__rn") <= most + 1).drop("__rn"), "first")
    there = first.groupBy("w").agg(F.min("other").alias("b"))
    wanted = stored(asked.filter(F.size(words) > 0).select(key, F.col(words).alias("w")), "asked")
    kinds = wanted.groupBy("w").agg(F.min(key).alias("a"))
    left = kinds.select("a", F.size("w").alias("m"), F.explode("w").alias("word"))
    right = there.select("b", F.size("w").alias("n"), F.explode("w").alias("word"))
    shared = left.join(right, "word").groupBy("a", "b").agg(F.count("*").alias("c"), F.max("m").alias("m"), F.max("n").alias("n"))
    scored = shared.select("a", "b", (100.0 * F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("score")).filter(F.col("score") > above)
    met = scored.join(there, "b").select("a", "score", "w").join(first, "w").select("a", "score", "other")
    near = met.withColumn("__rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "other"))).filter(F.col("__rn") <= most + 1).drop("__rn")
    found = wanted.join(kinds, "w").select(key, "a").join(near, "a").filter(F.col(key) != F.col("other"))
    return found.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "other"))).filter(F.col("__rn") <= most).select(key, "other", "score")
