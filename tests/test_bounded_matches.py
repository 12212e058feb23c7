"""Matches whose rows must grow with the input, not with the pairs of one key."""

from __future__ import annotations

import random

from duskwatch.operators import forensics, knowledge, matching
from duskwatch.plans import more_queries


def _rows_of_joins(spark, run) -> int:
    """Rows that the query shuffled, from Spark's own counters."""
    store = spark.sparkContext._jsc.sc().statusStore
    written = lambda: store().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    run()
    return written() - before


def test_most_alike_equals_plain_search(spark):
    rng = random.Random(3)
    sets = [sorted(rng.sample("abcdefg", rng.randint(1, 4))) for _ in range(25)]
    rows = [(i, rng.choice(sets)) for i in range(300)] + [(900, []), (901, None)]
    table = spark.createDataFrame(rows, "id long, w array<string>").repartition(3)
    got = sorted(map(tuple, matching.most_alike(table.filter("id % 7 = 0"), table, "id", "w", 30, 5).collect()))
    want = []
    for i, w in rows:
        if i % 7 == 0 and w:
            scored = [(-100.0 * len({*w} & {*v}) / len({*w} | {*v}), k) for k, v in rows if k != i and v]
            want += [(i, k, -s) for s, k in sorted(scored)[:5] if -s > 30]
    assert got == sorted(want)


def test_equal_word_sets_are_compared_once(spark):
    table = lambda n: spark.range(n).selectExpr("id", "array(concat('x', id % 3), 'y') AS w")
    few, many = (_rows_of_joins(spark, lambda n=n: matching.most_alike(table(n).filter("id % 5 = 0"), table(n), "id", "w", 30, 5).collect()) for n in (1000, 8000))
    assert many < 16 * few


def test_vendor_matches_do_not_grow_with_pairs(spark, tmp_path):
    sizes = []
    for n in (3000, 24000):
        folder = str(tmp_path / str(n))
        spark.range(n).selectExpr("id AS p_partkey").write.parquet(f"{folder}/part.parquet")
        spark.range(n // 4).selectExpr("id AS s_suppkey").write.parquet(f"{folder}/supplier.parquet")
        sizes.append(_rows_of_joins(spark, lambda: more_queries.exact_or_vendor_match(spark, folder).collect()))
    assert sizes[1] < 16 * sizes[0]


def test_levels_of_descendants_shrink(spark, monkeypatch):
    kept, write = [], forensics.stored
    monkeypatch.setattr(forensics, "stored", lambda df, name: kept.append((name, out := write(df, name))) or out)
    edges = spark.range(1, 3000).selectExpr("id AS node", "id div 2 AS parent").filter("parent > 0")
    got = {r.ancestor: (r.descendants, r.depth) for r in forensics.descendants(edges).collect()}
    assert got[1] == (2998, 11) and got[1499] == (2, 1) and 1500 not in got
    assert sum(df.count() for name, df in kept if name.startswith("level")) <= 3000  # pairs of node and ancestor are ten times as many


def test_equal_patterns_and_impossible_words_are_not_looked_for(spark, monkeypatch):
    rng = random.Random(5)
    names = ["large ring", "Hot bolt", "old plate", "", "boltring"]
    patterns = [(f"P{i:03}", rng.choice(names), rng.choice(["SMALL", "Hot", None])) for i in range(200)] + [("P000", "blue", "ring"), ("P000", "blue", "ring")]
    vocabulary = ["ring", "RING", "bolt", "plate", "large rin", "large ring\n", "large ringer", "boltring", "boltrings", "smal", "old", "hot bolt\nsmall", "xyzzy", "blue", "", None]
    evidence = [(i, rng.choice(vocabulary)) for i in range(60) for _ in range(rng.randint(1, 3))]
    seen = {}
    plain = matching.substring_matches

    def looked_for(texts, key, text, words, word, *more):
        seen.update(texts=texts.count(), words={r[0] for r in words.collect()})
        return plain(texts, key, text, words, word, *more)

    monkeypatch.setattr(knowledge, "substring_matches", looked_for)
    table = spark.createDataFrame(patterns, "pattern_id string, name string, description string")
    rows = spark.createDataFrame(evidence, "id long, keyword string")
    texts = [(p, "\n".join(x for x in (n, d) if x is not None).lower()) for p, n, d in patterns]
    want = []
    for k in {i for i, _ in evidence}:
        words = [w.lower() for i, w in evidence if i == k and w and len(w) > 3]
        found = sorted({p for p, t in texts if any(w in t for w in words)})[:5] or ["P002", "P010"]
        want += [(k, p, r) for r, p in enumerate(found, 1)]
    for most_chars in (matching.HEAD_CHARS, 0):
        monkeypatch.setattr(knowledge, "possible_words", lambda *a, n=most_chars: matching.possible_words(*a, n))
        assert sorted(map(tuple, knowledge.pattern_matches(rows, "id", table, fallback=("P002", "P010")).collect())) == sorted(want)
        assert seen["texts"] == len({t for _, t in texts})
        assert ("xyzzy" in seen["words"]) == (most_chars == 0)
