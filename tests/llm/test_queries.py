"""The registered queries with production parameters on the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from duskwatch.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_language": "doc_id held_out lang_pred score",
    "op4_warc_packages": "page_id payload_bytes payload_digest record_type refers_to",
    "op5_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op6_mixing": "doc_id size source_size target taken",
    "op7_simhash": "doc_id fingerprint component_id",
    "op8_token_store": "doc_id start n_tokens ids_crc32",
    "op10_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op13_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF).toPandas() for name, query in queries.QUERIES.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_columns_and_rows(results, docs):
    for name, columns in COLUMNS.items():
        found = results[name]
        assert set(columns.split()) <= set(found.columns), name
        assert len(found) == (len(docs) if "doc_id" in columns else found["page_id"].nunique()), name
    assert {"doc_id", "item_id"} <= set(results["op9_decontamination"].columns)


def test_sql_agrees(results):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql).fetchdf()
        got = results[name][list(want.columns)]
        plain = lambda f: sorted(repr([None if pd.isna(x) else (int(x) if isinstance(x, float) else x) for x in r]) for r in f.astype(object).values.tolist())
        assert plain(got) == plain(want), name


def test_held_out_rows(results, docs):
    for name, n, rest in (("op2_toxicity", 5, 0), ("op3_language", 4, 2)):
        for r in results[name].itertuples():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) and 0 <= r.score <= 1
    assert all(r.predicted == int(r.score >= 0.5) for r in results["op2_toxicity"].itertuples())
    right = [r.lang_pred == docs[r.doc_id].lang for r in results["op3_language"].itertuples() if r.held_out and docs[r.doc_id].lang]
    assert sum(right) > 0.9 * len(right)


def test_mix_keeps_targets(results, docs):
    size, taken, target = Counter(), Counter(), {}
    for r in results["op6_mixing"].itertuples():
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) and r.taken <= 2 * r.size
        source = docs[r.doc_id].source
        size[source] += r.size
        taken[source] += r.taken
        target[source] = r.target
    for r in results["op6_mixing"].itertuples():
        assert r.source_size == size[docs[r.doc_id].source]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) and all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_repeats_equal_brute_force(results, docs):
    data = {i: (r.text or "").encode() for i, r in docs.items()}
    seen = Counter(hash(d[j : j + 400]) for d in data.values() for j in range(len(d) - 399))
    for r in results["op10_repeats"].itertuples():
        d, gone = data[r.doc_id], set()
        for j in range(len(d) - 399):
            if seen[hash(d[j : j + 400])] > 1:
                gone.update(range(j, j + 400))
        kept = bytes(c for j, c in enumerate(d) if j not in gone)
        spans = sum(j - 1 not in gone for j in gone)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.repeats) == (len(d), len(gone), spans, hashlib.sha256(kept).hexdigest(), bool(gone))
