"""A word is encoded once, whatever signs stand behind it."""

from __future__ import annotations

from types import SimpleNamespace

import pyarrow as pa
from duskwatch.llm.tokenizing import UnitEncoder, vocabulary


def test_words_of_rare_units_are_encoded_once():
    encoder, seen = UnitEncoder(vocabulary()), []
    library = encoder.library
    model = SimpleNamespace(tokenize=lambda piece: seen.append(piece) or library.model.tokenize(piece))
    encoder.library = SimpleNamespace(model=model, encode=library.encode)
    signs = [",", ".", "!!", ".\n", "***", "&&", "", "#;", " Zürnung"]
    texts = [f"x zygomorphic{a} Zürnung{b} zygomorphic" for a in signs for b in signs]
    got = encoder.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) == len(set(seen)) < 20


def test_full_caches_change_no_ids():
    small = UnitEncoder(vocabulary(), cache_units=2, cache_pieces=2)
    texts = ["one, two. three! one, two.", "", "four two one? 12 12.", "don't one"]
    got = small.encode(pa.array(texts))
    assert [x.tolist() for x in got] == [small.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(small.pieces) == 2 and len(small.units) <= 2
