"""Every operator against a brute-force version on texts with nulls, blanks, ties, repeats and long rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duskwatch.llm import decontaminate, language_masks, mixing, near_copies, repeats, toxic_spans
from duskwatch.llm.block_names import block_name_dedup
from duskwatch.llm.mixing import mix, targets
from duskwatch.llm.repeats import cut, remove_repeats
from duskwatch.llm.simhash import close_pairs, fingerprint, node_masks, simhash_components
from duskwatch.llm.token_counts import token_counts
from duskwatch.llm.token_store import read_store, write_store
from duskwatch.llm.tokenizing import UnitEncoder, vocabulary
from duskwatch.llm.warc_zip import read_packages, write_packages

SCHEMA = "doc_id long, text string, lang string, source string, name string, size long, `at` int, `key` string, `range` int, uid long"


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gämma", "DELTA", "eps,", "zeta.", "Éta", "thé"]
    out = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))
        out.append((i, text, rng.choice(["en", "fr"]), rng.choice(["a", "b", None])))
    out += [(100, None, None, None), (101, "", "en", "a"), (102, " \n\t ", "fr", "b"), (103, None, "en", "c"), (None, "alpha Beta", "en", "a")]
    out += [(104, out[3][1].upper(), "en", "a"), (105, out[3][1].lower(), "en", "a"), (3, out[3][1], "en", "a"), (106, out[4][1] + " tail", "en", "a"), (107, "word " * 3000, "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, "k", 3, 4) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_slices_keep_all_rows_in_bounded_pieces():
    import pyarrow as pa

    from duskwatch.llm.shared import slices

    batch = pa.RecordBatch.from_pydict({"i": [1, 2, 3, 4, 5], "t": ["aa", None, "b" * 11, "", "c"]})
    cut_up = lambda b, most: [x.column(0).to_pylist() for x in slices(b, 1, most)]
    assert cut_up(batch, 2) == [[1, 2], [3], [4, 5]] and cut_up(batch, 100) == [[1, 2, 3, 4, 5]]
    assert cut_up(batch.slice(3), 1) == [[4, 5]] and cut_up(batch.slice(0, 0), 1) == []


def test_block_names(docs, rows, empty):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[lower(text)].append(i)
    for bits, block in ((64, 512), (4, 128)):
        found = block_name_dedup(docs, block_bytes=block, hash_bits=bits).collect()
        assert len(found) == len(rows)
        for key, ids in groups.items():
            digest = hashlib.sha256(key.encode()).hexdigest()
            mine = [r for r in found if r.text_sha256 == digest]
            keep = max((i for i in ids if i is not None), default=None)
            assert len(mine) == len(ids) and {r.group_size for r in mine} == {len(ids)} and {r.keep_id for r in mine} == {keep}
            assert [r.doc_id for r in mine if r.kept] == [keep]
        assert len({(r.n_blocks, r.block_name, r.text_sha256) for r in found}) == len(groups)
    assert block_name_dedup(empty).count() == 0


def test_mixing_of_many_sources(docs, monkeypatch):
    few = sorted(map(repr, mix(docs).collect()))
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 1)
    many = sorted(map(repr, mix(docs).collect()))
    assert few == many
    carried = mix(docs, carry=tuple(docs.columns)).select("carried.*")
    assert carried.columns == docs.columns and carried.count() == docs.count()


def test_mixing(docs, rows, empty):
    assert targets([10.0, 10.0], [3.0, 1.0], 1.5, 2.0) == [20.0, 10.0]
    first, second = (sorted(map(tuple, mix(d).select("doc_id", "size", "source", "target", "taken").collect()), key=repr) for d in (docs, docs.repartition(5)))
    assert first == second and len(first) == len(rows)
    taken, target = Counter(), {}
    for _, size, source, goal, n in first:
        assert 0 <= n <= 2 * size
        taken[source] += n
        target[source] = goal
    assert all(taken[s] == int(target[s]) for s in target)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert mix(empty).count() == 0


def test_mixing_takes_tied_rows_one_by_one(spark):
    """Rows that repeat an id, and rows without one, tie at the cut: budgets stay exact and no row exceeds two epochs."""
    tied = [(7, "a b c", "x")] * 9 + [(None, "d e", "y")] * 7 + [(8, None, "y"), (9, "", "z")]
    mixed = mix(spark.createDataFrame(tied, "doc_id long, text string, source string")).collect()
    assert len(mixed) == len(tied) and all(0 <= r["taken"] <= 2 * r["size"] for r in mixed)
    for source in "xyz":
        own = [r for r in mixed if r["source"] == source]
        assert sum(r["taken"] for r in own) == int(own[0]["target"])


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", lower(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components_of(keys, linked):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


def test_simhash(docs, rows, empty):
    prints = {t: brute_print(t) for _, t, *_ in rows}
    assert all(fingerprint(t) & (1 << 64) - 1 == p for t, p in prints.items())
    parts = components_of(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for i, t, *_ in rows:
        least[parts[prints[t]]].append(i)
    want = sorted((repr(i), f"{prints[t]:016x}", min((x for x in least[parts[prints[t]]] if x is not None), default=None)) for i, t, *_ in rows)
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash_components(docs).collect())
    assert got == want
    assert simhash_components(empty).count() == 0


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(20)]))
    rank = prints.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    prints = prints[np.argsort(rank)]
    found = {(int(i), int(j)) for a, b in close_pairs(prints, 2) for i, j in zip(a, b)}
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    assert found == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    masks = node_masks(2)
    assert all(any((int(prints[i]) ^ int(prints[j])) & m & (1 << 64) - 1 == 0 for m in masks) for i, j in found)


def test_token_counts_and_store(docs, rows, empty):
    library = UnitEncoder(vocabulary())
    ids = {t: np.frombuffer(library.whole(t or ""), "<u2").astype("<u4") for _, t, *_ in rows}
    got = sorted(map(repr, map(tuple, token_counts(docs, max_tokens=50, sample_rows=5, table_units=3).collect())))
    assert got == sorted(repr((i, len((t or "").encode()), len(ids[t]), len(ids[t]) > 50)) for i, t, *_ in rows)
    read = read_store(write_store(docs)).orderBy("start").collect()
    assert len(read) == len(rows) and [r.start for r in read] == list(np.cumsum([0] + [r.n_tokens for r in read[:-1]]))
    assert [r.doc_id for r in read] == sorted((i for i, *_ in rows), key=lambda x: (x is not None, x))
    want = Counter((i, tuple(np.append(ids[t], 2).tolist())) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in read) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in read)
    assert token_counts(empty).count() == 0 and read_store(write_store(empty)).count() == 0


def test_encoder_equals_library():
    library = UnitEncoder(vocabulary())
    import pyarrow as pa

    parts = [" ", "  ", "\n", " \n", "\t", "a", "b1", "'s", "é", "!", "\x1c", "<|endoftext|>", "日本", "\0", " x", "x ", "\n\n", "ß9!?", "×", "µ", "\x85", "\xa0"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert [x.tobytes() for x in library.encode(pa.array(texts))] == [library.whole(t) for t in texts]


def test_damaged_store_is_noticed(docs):
    store = write_store(docs)
    store.manifest = store.manifest.withColumn("root", F.lit("00"))
    with pytest.raises(ValueError, match="manifest"):
        read_store(store)


@pytest.mark.parametrize("core_classes", [50_000, 1])
def test_repeats(docs, rows, empty, monkeypatch, core_classes):
    monkeypatch.setattr(repeats, "CORE_CLASSES", core_classes)
    length = 60
    count = Counter()
    for _, t, *_ in rows:
        data = (t or "").encode()
        count.update(data[j : j + length] for j in range(len(data) - length + 1))
    want = []
    for i, t, *_ in rows:
        data = (t or "").encode()
        kept, runs = cut(data, [(j, j) for j in range(len(data) - length + 1) if count[data[j : j + length]] > 1], length)
        want.append(repr((i, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())))
    got = [repr(tuple(r)) for r in remove_repeats(docs, length=length, gram=8, window=24, with_text=False).collect()]
    assert sorted(got) == sorted(want)
    assert remove_repeats(empty).count() == 0


def test_warc_packages(spark):
    pages = [(i, f"http://h/{i}", ("<p>%d</p>" % (i % 4)) * 200) for i in range(20)] + [(30, None, None), (31, "u", ""), (32, "a b", "short"), (33, "a", "short"), (None, "x", "<p>1</p>" * 200)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, first int").repartition(3)
    got = {r.page_id: r for r in read_packages(spark, write_packages(df)).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if h == html and j is not None]
        r = got[None if i is None else str(i)]
        revisit = len(data) >= 1000 and i is not None and i < max(same)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert r.record_type == ("revisit" if revisit else "response") and r.refers_to == (str(max(same)) if revisit else None)
        assert r.payload is None if revisit else bytes(r.payload) == data
    assert read_packages(spark, write_packages(df.limit(0))).count() == 0


def test_decontamination(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "two words")]
    docs = []
    for d in range(80):
        body = [word() for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            passage = items[d % 12][1].split()
            if d % 2:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = passage
        docs.append((d, " ".join(body).upper() if d % 4 == 0 else " ".join(body)))
    docs += [(90, None), (91, ""), (None, items[0][1]), (92, "so Two, words!")]
    want = {}
    for i, text in items:
        w = decontaminate.words_of(text)
        if not w:
            continue
        n = min(5, len(w))
        grams = Counter(zip(*(w[k:] for k in range(n))))
        for d, t in docs:
            dw = decontaminate.words_of(t)
            best = 0.0
            for s in range(max(1, len(dw) - len(w) + 1)):
                g = Counter(zip(*(dw[s : s + len(w)][k:] for k in range(n))))
                both = sum((g & grams).values())
                best = max(best, both / (g.total() + grams.total() - both))
            if best >= 0.8:
                want[d, i] = pytest.approx(best)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(frame, bench).collect()}
    assert got == want and len(want) > 10
    assert decontaminate.contamination(frame, bench.limit(0)).count() == 0
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    for name, bound in (("ITEMS_AT_ONCE", 4), ("ITEM_BYTES", 1), ("WINDOWS_AT_ONCE", 2)):
        monkeypatch.setattr(decontaminate, name, bound)
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(frame, bench).collect()} == want


def test_language(spark):
    rng = random.Random(4)
    parts = {"aa": ["lar", "mo", "ti", "ven"], "bb": ["sch", "unk", "ber", "ost"]}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(3)) for _ in range(30)), x) for i in range(200) for x in [rng.choice(["aa", "bb"])]]
    rows += [(300, None, "aa"), (301, "123 !", "bb"), (302, "", None), (None, "larmo", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_masks.fit_languages(df.filter("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in language_masks.identify(df, model).collect()}
    held = [(got[i].lang_pred, x) for i, _, x in rows if i is not None and i % 2 and i < 300]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert [got[i].lang_pred for i in (300, 301, 302)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in got.values())
    none = language_masks.fit_languages(df.limit(0))
    assert {r.lang_pred for r in language_masks.identify(df, none).collect()} == {"und"}


def test_language_masks_equal_exact_sets(spark, monkeypatch):
    monkeypatch.setattr(language_masks, "LETTERS_AT_ONCE", 50)
    rng, names = random.Random(11), [f"l{n:03d}" for n in range(70)]
    texts = {n: ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4)] for n in names}
    rows = [(i, " ".join(rng.choices(texts[n], k=12)), n, 1.0) for i, n in enumerate(names * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language_masks.fit_languages(df)
    assert model.languages == names and model.masks.shape[0] == 2

    def plain(text):
        padded = f"  {text}  "
        return [padded[i : i + 4] for i in range(len(padded) - 3)]

    docs_with = defaultdict(Counter)
    for _, t, n, _ in rows:
        for g in set(plain(t)):
            docs_with[g][n] += 1
    held = {g: {n for n, k in c.items() if k >= min(3, 4) and k / 4 >= 0.2 * max(c.values()) / 4} for g, c in docs_with.items()}
    for _, t, n, _ in rows[:100]:
        exact = Counter(x for g in plain(t) for x in held[g])
        found = sum(model.holders(h) for h in language_masks.grams(t))
        assert all(found[i] >= exact[x] for i, x in enumerate(names)) and sum(found) <= sum(exact.values()) + 0.02 * 70 * len(plain(t))
    got = {r.doc_id: r.lang_pred for r in language_masks.identify(df, model).collect()}
    assert all(got[i] == n for i, _, n, _ in rows)
    assert language_masks.identify(df.limit(0), model).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        body, bad = [word() for _ in range(rng.randint(5, 40))], i % 4 == 0
        if bad:
            body[rng.randrange(len(body))] = rng.choice(["nastiest", "Vilely"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (None, "nastiest")]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    model = toxic_spans.fit_toxic(df, marks.filter("doc_id % 5 <> 0"))
    got_rows = toxic_spans.score_toxic(df, model).collect()
    got = {r.doc_id: r for r in got_rows}
    held = [(got[i].score >= 0.5, y) for i, y in labels if i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    text = dict(rows)
    for i, y in labels[::4]:
        assert any(text[i][s.start : s.end].lower() in ("nastiest", "vilely") for s in got[i].spans)
    assert got[900].spans == [] and got[901].score < 0.5 and len(got) == len(rows)
    blank = toxic_spans.fit_toxic(df, marks.limit(0))
    assert {r.score < 0.5 for r in toxic_spans.score_toxic(df, blank).collect()} == {True}
    assert toxic_spans.score_toxic(df.limit(0), model).count() == 0
    clash = df.selectExpr("*", "1 score", "2 label", "3 AS `key`", "array() spans")
    assert sorted(map(repr, toxic_spans.score_toxic(clash, toxic_spans.fit_toxic(clash, marks.filter("doc_id % 5 <> 0"))).collect())) == sorted(map(repr, got_rows))


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = random.Random(12)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(clean, k=3100) + (["zzbad", "yyworse"] if i % 2 else ["fine"]) + ["end"])) for i in range(80)]
    df, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxic_spans.fit_toxic(df, marks.filter("doc_id >= 20"))
    for r in toxic_spans.score_toxic(df, model).collect():
        assert (r.score >= 0.5) == (r.doc_id % 2 == 1)
        assert [rows[r.doc_id][1][s.start : s.end] for s in r.spans] == (["zzbad yyworse"] if r.doc_id % 2 else [])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    scores, move, start = rng.normal(size=5), rng.normal(size=(2, 2)), rng.normal(size=2)
    total, ones = 0.0, np.zeros(5)
    for bits in range(32):
        y = [bits >> t & 1 for t in range(5)]
        p = np.exp(start[y[0]] + sum(s for s, v in zip(scores, y) if v) + sum(move[a, b] for a, b in zip(y, y[1:])))
        total += p
        ones += p * np.array(y)
    marginal, _ = toxic_spans.chain_marginals(scores, np.array([0, 5]), move, start)
    assert marginal == pytest.approx(ones / total)


def plain_chain(scores, move, start):
    """Log of the normaliser, marginals and summed pair marginals of one chain, in logarithms, token by token."""
    e = np.stack([np.zeros(len(scores)), scores], axis=1)
    alpha, beta = [start + e[0]], [np.zeros(2)]
    for t in range(1, len(scores)):
        alpha.append(np.logaddexp.reduce(alpha[-1][:, None] + move, axis=0) + e[t])
    for t in range(len(scores) - 1, 0, -1):
        beta.insert(0, np.logaddexp.reduce(move + e[t] + beta[0], axis=1))
    z = np.logaddexp.reduce(alpha[-1])
    pairs = sum((np.exp(alpha[t - 1][:, None] + move + e[t] + beta[t] - z) for t in range(1, len(scores))), np.zeros((2, 2)))
    return z, np.exp(np.array(alpha) + np.array(beta) - z)[:, 1], pairs


def test_long_chains_are_one_chain():
    rng = np.random.default_rng(5)
    sizes = [3000, 0, 1, 256, 257, 511, 512, 513, 40, 1100]
    move, start, scores = rng.normal(size=(2, 2)) + np.eye(2) * 3, rng.normal(size=2), rng.normal(size=sum(sizes)) * 3
    ends = np.cumsum(sizes)
    marginal, pairs = toxic_spans.chain_marginals(scores, ends, move, start, with_pairs=True)
    plain = [plain_chain(scores[b - n : b], move, start) for n, b in zip(sizes, ends) if n]
    assert np.allclose(marginal, np.concatenate([m for _, m, _ in plain]), atol=1e-10)
    assert np.allclose(pairs, sum(p for *_, p in plain), atol=1e-7)


def test_gradient_equals_differences_of_the_likelihood():
    rng = np.random.default_rng(9)
    docs = []
    for n in (600, 5, 1):
        sizes = rng.integers(1, 3, n).astype(np.int32)
        docs.append((sizes, rng.integers(0, 12, sizes.sum()).astype(np.int32), rng.integers(0, 2, n).astype(np.uint8), 1))
    model = toxic_spans.ToxicModel(np.zeros(toxic_spans.SLOTS), rng.normal(size=(2, 2)), rng.normal(size=2), np.zeros(3))
    model.weights[:12] = rng.normal(size=12)

    def likelihood():
        total = 0.0
        for sizes, slots, tags, _ in docs:
            scores = np.bincount(np.repeat(np.arange(len(sizes)), sizes), model.weights[slots], len(sizes))
            path = model.start[tags[0]] + (scores * tags).sum() + model.transition[tags[:-1], tags[1:]].sum()
            total += path - plain_chain(scores, model.transition, model.start)[0]
        return total - toxic_spans.DECAY * len(docs) * (model.weights**2).sum() / 2

    found = toxic_spans.gradient(model, docs)
    for value, slope, places in ((model.weights, found[0], [(i,) for i in range(12)]), (model.transition, found[1], [(0, 0), (0, 1), (1, 0), (1, 1)]), (model.start, found[2], [(0,), (1,)])):
        for at in places:
            value[at] += 1e-4
            up = likelihood()
            value[at] -= 2e-4
            down = likelihood()
            value[at] += 1e-4
            assert slope[at] == pytest.approx((up - down) / 2e-4, abs=1e-4)


def test_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(rng.randint(80, 200))] for _ in range(15)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i in range(40):
        t = list(texts[i % 15])
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = word()
        rows.append((100 + i, " ".join(t)))
    rows += [(500, None), (501, ""), (None, rows[0][1])]
    grams = {i: Counter(near_copies.shingle_hashes(t, 5).tolist()) for i, t in rows if i is not None}

    def linked(a, b):
        both = sum((grams[a] & grams[b]).values())
        return both >= 0.8 * (grams[a].total() + grams[b].total() - both)

    want = set()
    parts = components_of(grams, linked)
    for root in set(parts.values()):
        want.add(min(k for k, r in parts.items() if r == root))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, other string")
    got = near_copies.near_copies(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == want | {None}


def check_near_copies(spark, rows):
    grams = {i: Counter(near_copies.shingle_hashes(t, 5).tolist()) for i, t in rows}

    def linked(a, b):
        both = sum((grams[a] & grams[b]).values())
        return both >= 0.8 * (grams[a].total() + grams[b].total() - both)

    parts = components_of(grams, linked)
    want = {min(k for k, r in parts.items() if r == root) for root in set(parts.values())}
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    return want


def test_near_copies_that_drift(spark):
    """Versions of a page that are similar to their neighbours alone, in mixed order of ids, beside a passage that unrelated texts share."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, passage = [], [word() for _ in range(120)]
    for page in range(6):
        words = [word() for _ in range(300)]
        ids = rng.sample(range(100), 12)
        for i in ids:
            rows.append((page * 100 + i, " ".join(words)))
            at = rng.randrange(0, 300 - 25)
            words[at : at + 25] = [word() for _ in range(25)]
    for i in range(30):
        own = [word() for _ in range(100)]
        rows.append((1000 + i, " ".join([*own, *passage])))
        own[50] = word()
        rows.append((2000 + i * 7 % 30, " ".join([*own, *passage, word()])))
    assert len(check_near_copies(spark, rows)) == 36


def test_runs_may_span_batches():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    element = np.sort(np.append(rng.integers(0, 40, 300), np.full(200, 40)))
    doc = rng.permutation(500)
    root, size, place = doc // 3, rng.integers(20, 30, 500), rng.integers(0, 6, 500)
    wide = pa.array([bytes([255] * near_copies.BUCKETS)] * 500, pa.binary())
    table = pa.RecordBatch.from_arrays([*(pa.array(x) for x in (element, root, doc, size << 32 | place)), wide], names=["element", "root", "doc_id", "n_place", "buckets"])
    want = set()
    for i in range(500):
        for j in range(500):
            fits = min(size[i] - place[i], size[j] - place[j]) >= 0.8 / 1.8 * (size[i] + size[j]) - 1e-6
            if element[i] == element[j] and doc[i] > doc[j] and root[i] != root[j] and fits:
                want.add((int(doc[i]), int(doc[j])))
    for step in (7, 64, 500):
        batches = [table.slice(i, step) for i in range(0, 500, step)]
        got = {p for b in near_copies._runs(0.8, None)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))}
        assert got == want
        for turn in (0, 1):
            stars = [p for b in near_copies._runs(0.8, turn)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
            assert len(stars) <= 500 and set(stars) <= want and len(stars) > 20
        rows = table.select(["element", "doc_id", "n_place"])
        shared = [x for b in near_copies._shared_elements(iter([rows.slice(i, step) for i in range(0, 500, step)])) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert shared == [x for x in zip(*(c.to_pylist() for c in rows.columns)) if (element == x[0]).sum() > 1]


def test_buckets_never_bound_too_low():
    rng = np.random.default_rng(8)
    for n in (5, 300, 5000, 200_000):
        both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (n, n // 3, n // 4))
        rows = [np.frombuffer(near_copies.bucket_counts(np.concatenate([both, x])), np.uint8)[None] for x in (a, b)]
        assert near_copies._most_shared(*rows)[0] >= n
    assert near_copies._most_shared(*(np.frombuffer(near_copies.bucket_counts(rng.integers(0, 1 << 63, 300, dtype=np.uint64)), np.uint8)[None] for _ in "ab"))[0] < 200


def test_near_copies_of_short_texts_and_templates(spark):
    """Short texts with a word more, texts with words appended, and documents that share most of their text with many others."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, template = [], [word() for _ in range(200)]
    for i in range(60):
        short = [word() for _ in range(20)]
        rows += [(2 * i, " ".join(short)), (2 * i + 1, " ".join([*short, word()]))]
    for i in range(20):
        longer = [word() for _ in range(60)]
        rows += [(200 + 2 * i, " ".join(longer)), (201 + 2 * i, " ".join(longer + [word() for _ in range(rng.randint(5, 16))]))]
    for i in range(25):
        own = [word() for _ in range(55)]
        copy = [*own[:50], *(word() for _ in range(5))]
        rows += [(1000 + i, " ".join([*template[:100], *own, *template[100:]])), (3000 - i, " ".join([*template[:100], *copy, *template[100:]]))]
    check_near_copies(spark, rows)


def test_corpus_order_marks_what_equal_strings_share():
    rng, length, window = random.Random(3), 30, 8
    pool = ["".join(rng.choice("ab\0") for _ in range(length + window)).encode() for _ in range(6)]
    run, copies, shape, data, want = [], [], [], [], []
    for number in range(300):
        back = rng.randint(0, window - 1)
        span = rng.randint(0, back)
        whole = rng.choice(pool)[: back + length]
        whole = bytes(rng.choice(b"ab") if i < back and rng.random() < 0.2 else c for i, c in enumerate(whole))
        run.append(number // 60), copies.append(1), shape.append(back << 16 | span), data.append(whole[: span + length])
    seen = defaultdict(set)
    for i, d in enumerate(data):
        if (run[i], shape[i], d) in {(run[j], shape[j], data[j]) for j in range(i)}:
            run[i] = 1000 + i  # classes differ within a run
        for a in range((shape[i] >> 16) - (shape[i] & 65535), (shape[i] >> 16) + 1):
            seen[run[i], a, d[(shape[i] >> 16) - a :][:length]].add(i)
    got = repeats.corpus_order(np.array(run), np.array(copies), np.array(shape), data, length)
    want = np.zeros_like(got)
    for (_, a, _), holders in seen.items():
        if len(holders) > 1:
            for i in holders:
                want[i, a] = True
    assert want.any() and not want.all() and (got == want).all()
