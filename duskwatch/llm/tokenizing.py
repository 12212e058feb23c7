"""Token ids of whole texts, unit by unit, exactly as the tokenizers library gives them.

Where no white space follows a space, a byte-level pre-tokenizer never joins that space with what stands
before it. So a text is the concatenation of units that start at spaces. Arrow finds the distinct units of a
batch, a worker's cache knows the frequent ones, and only the others are encoded: a plain unit by the library's
model from its pre-tokens, which are kept as well since a rare unit is often a known word and a sign, anything else by
the whole library. Texts with a special string or with white space
behind a space, and all texts of other kinds of vocabulary, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A word that is one pre-token in any byte-level pattern: Latin letters after at most one space.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Pre-tokens of plain units: such words, ASCII digits, ASCII signs but the apostrophe, single line ends.
_PLAIN = re.compile(_WORD.pattern + r"| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n(?!\n)")
_DOUBTFUL = r" [\s\x1c-\x1f\x85\p{Z}]"
#: Units of several pre-tokens, and pre-tokens, kept by a worker; beyond it, new ones are encoded each time they come.
CACHE_UNITS = 150_000
CACHE_PIECES = 1_000_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if visible in Latin-1, else from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    """Packed little-endian ids (16 bits if the vocabulary allows) of texts under one vocabulary file."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, cache_pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"] or {}
        self.by_units = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step["add_prefix_space"] and not spec["normalizer"]
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.room, self.piece_room = cache_units, cache_pieces

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def whole(self, text: str) -> bytes:
        """Packed ids of a text by the library alone."""
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if piece.isascii() and piece.isprintable():
                letters = piece.replace(" ", self.letters[32])
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            got = self.pack([t.id for t in self.library.model.tokenize(letters)])
            if len(self.pieces) < self.piece_room:
                self.pieces[piece] = got
        return got

    def _unit(self, unit: str) -> bytes:
        if _WORD.fullmatch(unit):
            return self._piece(unit)
        pieces = _PLAIN.findall(unit)
        if sum(map(len, pieces)) != len(unit):
            return self.whole(unit)
        return b"".join(map(self._piece, pieces))

    def unit(self, unit: str) -> bytes:
        """Packed ids of a space and the unit behind it."""
        spaced = " " + unit
        got = self.pieces.get(spaced)
        if got is None:
            got = self.units.get(unit)
        if got is None:
            got = self._unit(spaced)
            if len(self.units) < self.room and spaced not in self.pieces:
                self.units[unit] = got
        return got

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], dict[int, bytes]]:
        """Unit numbers of all texts, where each text's begin, the distinct units, and ids of texts encoded whole.

        Number -1 - i stands for the first unit of text i, which has no space before it.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, _DOUBTFUL) if self.by_units else pc.is_valid(texts)
        for special in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        whole = {int(i): self.whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = offsets[:-1] - offsets[0]
        numbers[starts] = -1 - np.arange(len(starts))
        firsts = flat.take(pa.array(starts)).to_pylist()
        whole |= {i: self._unit(f) if f else b"" for i, f in enumerate(firsts) if i not in whole}
        return numbers, np.append(starts, len(numbers)), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), whole

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        if not len(texts):
            return []
        numbers, starts, units, firsts = self.split(texts)
        packed = [*map(self.unit, units), *(firsts[i] for i in range(len(texts) - 1, -1, -1))]
        parts = [packed[n] for n in numbers.tolist()]
        cuts = starts.tolist()
        return [np.frombuffer(b"".join(parts[a:b]), self.dtype) for a, b in zip(cuts[:-1], cuts[1:])]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder for a vocabulary file; the cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
