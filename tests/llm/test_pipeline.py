"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from duskwatch.llm.decontaminate import words_of
from duskwatch.llm.near_copies import shingle_hashes
from duskwatch.llm.tokenizing import UnitEncoder, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).toPandas()
        tables.append(out)
        docs = spark.createDataFrame(out) if len(tables) < len(corpus_pipeline.STAGES) + 1 else None
    return tables


def test_toxic_documents_go(spark, stages):
    toxic = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    kept = set(stages[1]["doc_id"])
    clean = [i for i, y in toxic.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert list(stages[1].columns) == list(stages[0].columns)


def test_one_of_each_group_of_near_copies_stays(stages):
    grams = {i: Counter(shingle_hashes(t, 5).tolist()) for i, t in zip(stages[1]["doc_id"], stages[1]["text"])}
    root = {i: i for i in grams}
    ids = sorted(grams)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sum((grams[a] & grams[b]).values())
            if both >= 0.8 * (grams[a].total() + grams[b].total() - both):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    assert set(stages[2]["doc_id"]) == {i for i in ids if root[i] == i}


def test_leaks_go(spark, stages):
    items = [words_of(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()["text"]]
    bad = set()
    for i, text in zip(stages[2]["doc_id"], stages[2]["text"]):
        joined = " " + " ".join(words_of(text)) + " "
        bad |= {i for w in items if " " + " ".join(w) + " " in joined}
    kept = set(stages[3]["doc_id"])
    assert not bad & kept
    assert len(kept) >= len(stages[2]) - 2 * len(bad) - 2


def test_mix_and_tokens(stages):
    copies = Counter(stages[4]["doc_id"])
    assert max(copies.values()) <= 2 and set(copies) <= set(stages[3]["doc_id"])
    encoder, start = UnitEncoder(vocabulary()), 0
    want = []
    for i, text in sorted(zip(stages[4]["doc_id"], stages[4]["text"])):
        ids = np.append(np.frombuffer(encoder.whole(text), "<u2").astype("<u4"), 2).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(stages[5][["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None), key=lambda r: r[1])
    assert got == want


def test_stages_keep_odd_rows_and_further_columns(spark, tmp_path):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "a", 1), (1, "alpha beta gamma delta epsilon zeta", "a", 1), (2, None, "b", 2), (3, "", None, 3), (None, "one two three", "a", 4),
            (4, "so long " * 3000, "b", 5)]
    schema = "doc_id long, text string, source string, gone int, size long, score double, label int, `range` int, item_id long"
    for part in (rows, []):
        docs = spark.createDataFrame([(*r[:3], r[3], 7, 0.5, 1, 2, 3) for r in part], schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), schema)
        kept = {r.doc_id for r in docs.collect()}
        assert kept >= ({None, 4} if part else set())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
