"""Lexical search, prefix trie and Katz model against brute force, with small shards, segments, ranges and chunks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.llm import katz, treaps
from duskwatch.llm.prefix_trie import prefix_trie
from duskwatch.llm.treaps import TERM, best, build_index, search

SCHEMA = "doc_id long, text string, term string, score long, shard int, chunk long, `rank` int"


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gämma", "DELTA-x", "eps,", "zeta.", "Éta", "the", "the", "the", "rare7"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    out += [(200, None), (201, ""), (202, " \n.,!"), (None, "alpha Beta rare7"), (203, out[3][1]), (3, out[3][1]), (204, "word " * 3000 + "\x0b end")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranked(rows, items, k):
    terms = [(i, Counter(re.findall(TERM, lower(t)))) for i, t in rows]
    held = [c for _, c in terms if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(re.findall(TERM, lower(text)))
    for item, wanted in asked.items():
        found = []
        for i, c in terms:
            if c:
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
                score = sum(math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
                if score > 0:
                    found.append((-score, i is None, i))
        found.sort()
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, rows, docs, empty):
    items = [(1, "alpha rare7 BETA"), (2, None), (3, "nowhere"), (4, "the the éta"), (4, "gämma"), (None, "Zeta eps"), (5, "word end Delta x"), (6, "the")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for shard_docs, block in ((16_384, 200_000), (7, 3)):
        index = build_index(docs, shard_docs=shard_docs)
        for k in (1, 10):
            got = sorted((tuple(r) for r in search(index, table, k=k, block_terms=block).collect()), key=repr)
            assert got == ranked(rows, items, k)
    assert search(build_index(empty), table).count() == 0 and search(index, empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_index_takes_texts_longer_than_a_piece(spark):
    long = "lorem ipsum " * 500_000 + "needle"
    data = spark.createDataFrame([(1, long), (2, "needle lorem"), (3, "other")], "doc_id long, text string")
    index = build_index(data)
    assert (index.n_docs, index.n_terms) == (3, 1_000_004)
    assert [(r.doc_id, r["rank"]) for r in search(index, spark.createDataFrame([(1, "needle")], "item_id int, text string")).collect()] == [(2, 1), (1, 2)]


def test_treaps_are_heaps_and_search_trees_and_prune():
    rng = np.random.default_rng(3)
    impacts = rng.integers(1, 50, 400)
    starts = np.array([0, 1, 150])
    roots, left, right = treaps.treaps(starts, impacts)
    for start, end, root in zip(starts, [1, 150, 400], roots):
        seen = []

        def walk(i, top):
            if i >= 0:
                assert impacts[start + i] <= top
                walk(left[start + i], impacts[start + i])
                seen.append(i)
                walk(right[start + i], impacts[start + i])

        walk(root, 10**9)
        assert seen == list(range(end - start))
    size = 20_000
    doc, impact = np.append(np.arange(size), -1), np.append(rng.permutation(size) + 1, 0)
    roots, left, right = treaps.treaps(np.array([0]), impact[:-1])
    child = lambda x: np.append(np.where(x >= 0, x, size), size)
    _, found, score, scored = best(roots[:, None].astype(np.int64), np.array([[3]]), size, doc, impact, child(left), child(right), 10)
    assert sorted(score) == [3 * x for x in range(size - 9, size + 1)] and set(found) == set(np.argsort(-impact[:-1])[:10])
    assert scored < size / 20


def trie(rows, family=100, heads=6):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - int(math.fmod(c, family)), [])[:h] + v[h:]
    members = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    for node, cs in members.items():
        leaves = saved = 0
        stack = [node]
        while stack:
            x = stack.pop()
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            stack += kids[x]
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(260):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        say = rng.choice([["hi", "a", "böb"], ["x"], ["hi", "y" * 30, "z"]])
        rows += [(c, t, rng.choice(["user", "user", None]), rng.choice(say)) for t in range(n)]
    rows += [(300, t, "user", "hi") for t in range(5)] + [(c, t, "user", "hi") for c in range(301, 340) for t in range(7)]
    rows += [(None, 1, "user", "lost"), (401, None, "u", "first"), (401, None, "u", "first"), (401, 2, None, None), (401, 2, "b", "tie"), (502, 0, "user", "short"), (-7, 1, "a", "b")]
    rows += [(600, t, "u", "q" * (t % 7)) for t in range(40)] + [(601, t, "u", "q" * (t % 7)) for t in range(40)] + [(602, t, "u", "q" * (t % 7)) for t in range(23)]
    data = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn int, role string, text string, depth int, node string")
    want = trie(rows)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for segment, coalesced in ((64, "true"), (64, "false"), (4, "false"), (1, "false"), (4, "true")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
            spark.conf.set("spark.sql.shuffle.partitions", "4" if coalesced == "true" else "13")
            got = sorted((tuple(r) for r in prefix_trie(data.repartition(5), segment=segment).select(*columns).collect()), key=repr)
            assert got == want, (segment, coalesced)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert prefix_trie(data.limit(0)).count() == 0


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), ""]


def katz_scores(rows, train):
    uni, pairs = Counter(), Counter()
    for i, text in rows:
        if train(i):
            t = tokens(text)
            uni.update(t)
            pairs.update(zip(["", *t[:-1]], t))
    n, size = sum(uni.values()), len(uni)
    of = Counter(pairs.values())
    d = katz.discounts([of[r] for r in range(1, katz.MOST + 2)])
    one = lambda w: (uni[w] + 1) / (n + size + 1)
    lost, seen = defaultdict(float), defaultdict(int)
    for (v, w), r in pairs.items():
        lost[v] += r * (1 - d[r - 1]) if r <= len(d) else 0
        seen[v] += uni[w] + 1
    total = {v: c + (lost[v] == 0) for v, c in uni.items()}
    alpha = {v: (lost[v] or 1) / total[v] / (1 - seen[v] / (n + size + 1)) for v in uni}

    def p(v, w):
        r = pairs[v, w]
        return (d[r - 1] if r <= len(d) else 1) * r / total[v] if r else alpha.get(v, 1) * one(w)

    for v in uni:  # each context sums to one over the words and the class of all others
        assert sum(p(v, w) for w in [*uni, "never seen"]) == pytest.approx(1)
    out = []
    for i, text in rows:
        t = tokens(text)
        out.append((i, len(t), sum(uni[w] > 0 for w in t), sum(math.log10(one(w)) for w in t), sum(math.log10(p(v, w)) for v, w in zip(["", *t[:-1]], t))))
    return n, d, sorted(out, key=repr)


def close(got, want):
    got = sorted((tuple(r) for r in got), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] == pytest.approx(b[4])


def test_katz_equals_brute_force(spark, rows, docs, empty):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    many = [*rows, *[(1000 + i, " ".join(rng.choice(words) for _ in range(40))) for i in range(80)]]
    table = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    picked, train = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True)), lambda i: i is None or i % 7 != 2
    n, found, want = katz_scores(many, train)
    assert len(found) > 1
    for chunk, bucket in ((katz.CHUNK_TOKENS, katz.BUCKET_TOKENS), (500, 700)):
        model, scores = katz.fit_and_score(table, picked, chunk_tokens=chunk, bucket_tokens=bucket)
        assert model.n_tokens == n and model.discounts == pytest.approx(found)
        close(scores.collect(), want)
    model = katz.fit_katz(table, train=picked)
    close(katz.score_katz(table, model, chunk_tokens=900).collect(), want)
    close(katz.score_katz(docs, model).collect(), [w for w in want if w[0] is None or w[0] < 1000])
    assert katz.score_katz(empty, model).count() == 0
    _, none = katz.fit_and_score(docs, F.lit(False))
    assert {(r.n_known, r.base_score, r.score) for r in none.collect()} == {(0, 0.0, 0.0)}


def test_katz_takes_texts_longer_than_a_chunk(spark):
    long = " ".join(f"w{i % 977}" for i in range(1_200_000))
    data = spark.createDataFrame([(1, long), (2, "w1 w2 new"), (3, "w5 w6")], "doc_id long, text string")
    model, scores = katz.fit_and_score(data, F.col("doc_id") != 2, chunk_tokens=300_000)
    got = {r.doc_id: r for r in scores.collect()}
    assert got[1].n_tokens == 1_200_001 and got[2].n_known == 3 and got[2].n_tokens == 4
    _, _, want = katz_scores([(1, long), (2, "w1 w2 new"), (3, "w5 w6")], lambda i: i != 2)
    close([got[i] for i in got], want)


def test_discounts_only_where_counts_allow():
    assert katz.discounts([10, 0, 0, 0, 0, 0]) == () and katz.discounts([0] * 6) == ()
    assert all(0 < d < 1 for d in katz.discounts([1000, 300, 120, 70, 40, 25]))


def test_numbers_survive_packing():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 50, 1000))
    assert (katz.unpack(katz.pack(x)) == x).all() and (katz.unpack_sorted(katz.pack_sorted(x)) == x).all() and len(katz.unpack(katz.pack(x[:0]))) == 0
