"""Library encodings of whole texts, word by word.

A vocabulary's own pre-tokenizer never joins what stands on both sides of certain blanks, so a text is
cut there, each distinct word is encoded once by the library and kept in a bounded cache of two Arrow
columns, and a document is the concatenation of its words' ids. A text in which the cuts are not certain
(special strings, runs of blanks, unusual white space) goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 96 << 20  # of words and ids; beyond it the cache starts anew

#: Where this is found in a text, the cuts are not certain: runs of blanks, blanks beside line ends or at
#: either end, other white space, zero-width characters, and what opens the special strings.
_ODD = (
    r"[ \n][ \n]|^[ \n]|[ \n]$|<\||[\x00\x09\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}"
    r"\x{2028}-\x{202F}\x{205F}-\x{2064}\x{3000}\x{FEFF}]"
)
_START = "\0"  # marks what stands without a blank before it
#: Latin letters that stay one letter in lower case; U+0130 does not: its dot joins the punctuation after it.
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
#: A full stop or comma between a letter or digit and white space is always encoded on its own.
_STOP, _APART = rf"([0-9{_LETTERS}])([.,])([ \n])", "\\1 " + _START + "\\2\\3"
_PLAIN = f"^[{_LETTERS}]+$"
#: Letters, then ASCII punctuation without the apostrophe (which opens contractions).
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@\\[-`{-~]*)")

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """texts to little-endian unsigned 16-bit ids, with a cache that lives as long as the worker."""

    BLANK = ""  # what a word after a blank begins with

    WORDS = 1_000_000  # entries of the cache

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(True) > 65_536:
            raise ValueError("ids of more than 16 bits")
        self.keys, self.codes = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self._edge: np.ndarray | None = None

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("H", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def edge(self, begin: str, end: str) -> np.ndarray:
        """By id, whether the token begins and ends so."""
        if self._edge is None:
            self._edge = np.zeros(65_536, bool)
            self._edge[[i for t, i in self.tokenizer.get_vocab(False).items() if t.startswith(begin) and t.endswith(end)]] = True
        return self._edge

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Keys of the cache whose encodings, joined, are the text's."""
        raise NotImplementedError

    def together(self, text: str) -> np.ndarray:
        (got,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(got.ids, "<u2")

    def simple(self, words: pa.Array) -> pa.Array:
        """Encodings of words of letters alone, each after a blank: one call for all of them."""
        if not len(words):
            return pa.array([], pa.large_binary())
        ids = self.together(" " + " ".join(words.to_pylist()))
        starts = self.starts(ids)
        if len(starts) != len(words):
            return pa.array(self.library([self.BLANK + w for w in words.to_pylist()]), pa.large_binary())
        ends = 2 * np.append(starts, len(ids)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def opening(self, words: list[str]) -> list[bytes]:
        """Encodings of words of letters alone that open a text or a line."""
        return self.library(words)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Where words begin in the ids of words of letters."""
        raise NotImplementedError

    def spelt(self, key: str) -> str:
        """The string that a key of the cache stands for."""
        return key[1:] if key[:1] == _START else key if key[:1] == "\n" else self.BLANK + key

    def add(self, keys: pa.Array, codes: pa.Array) -> np.ndarray:
        """Where the new entries stand."""
        at = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.keys, self.codes = pa.concat_arrays([self.keys, keys]), pa.concat_arrays([self.codes, codes])
        return at

    def learn(self, words: pa.Array) -> np.ndarray:
        """Add the encodings of new words: their letters and the punctuation after them apart, where that is certain."""
        at = np.empty(len(words), np.int32)
        plain = pc.match_substring_regex(words, _PLAIN)
        cores, other = words.filter(plain), words.filter(pc.invert(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        at[plain] = self.add(cores, self.simple(cores))
        rest = other.to_pylist()
        split = [_SIMPLE.fullmatch(w) or (w[:1] in (_START, "\n") and _SIMPLE.fullmatch(w, 1)) or None for w in rest]
        cores = pa.array(list({m[1] for m in split if m and not m.start()}), pa.string())
        of = pc.index_in(cores, self.keys)
        new = cores.filter(pc.is_null(of))
        missing = pc.is_null(of).to_numpy(zero_copy_only=False)
        of = pc.fill_null(of, 0).to_numpy().copy()
        of[missing] = self.add(new, self.simple(new))
        known = dict(zip(cores.to_pylist(), self.codes.take(pa.array(of)).to_pylist(), strict=True))
        first = list({m[1] for m in split if m and m.start()})
        heads = dict(zip(first, self.opening(first), strict=True))
        tails = list({m[2] for m in split if m} | {"\n"})
        coded = dict(zip(tails, self.library(tails), strict=True))
        whole = iter(self.library([self.spelt(w) for w, m in zip(rest, split, strict=True) if not m]))
        line_end = {"\n": coded["\n"], _START: b""}
        found = [next(whole) if not m else line_end[w[0]] + heads[m[1]] + coded[m[2]] if m.start() else known[m[1]] + coded[m[2]] for w, m in zip(rest, split, strict=True)]
        at[~plain] = self.add(other, pa.array(found, pa.large_binary()))
        return at

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (no nulls). Distinct words are found by Arrow, so that Python sees only new ones."""
        whole = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        words = self.cut(pc.if_else(pa.array(whole), "", texts))
        coded = words.flatten().dictionary_encode()
        keys = coded.dictionary
        at = pc.index_in(keys, self.keys)
        if at.null_count:
            if len(self.keys) + at.null_count > self.WORDS or self.keys.nbytes + self.codes.nbytes > CACHE_BYTES:
                self.keys, self.codes = self.keys[:0], self.codes[:0]
                at = pa.nulls(len(keys), pa.int32())
            new = pc.is_null(at)
            at = pc.fill_null(at, 0).to_numpy().copy()
            at[new.to_numpy(zero_copy_only=False)] = self.learn(keys.filter(new))
            at = pa.array(at)
        ids = self.codes.take(at).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
        data = memoryview(ids.buffers()[2] or b"")
        at = ends[words.offsets.to_numpy()].tolist()
        odd = iter(self.library([t.as_py() for t in texts.filter(pa.array(whole))]))
        return [next(odd) if w else bytes(data[i:j]) for w, i, j in zip(whole.tolist(), at[:-1], at[1:], strict=True)]


class ByteEncoder(Encoder):
    """Byte-level pairs: a blank belongs to the word after it, a line end stands alone."""

    BLANK = " "

    def starts(self, ids: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.edge("Ġ", "")[ids])  # the byte of a blank opens a token

    def opening(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        ids = self.together("\n" + "\n".join(words))
        cuts = (2 * np.flatnonzero(ids == self.tokenizer.token_to_id("Ċ"))).tolist() + [2 * len(ids)]
        if len(cuts) != len(words) + 1:
            return self.library(words)
        ids = ids.tobytes()
        return [ids[i + 2 : j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def cut(self, texts: pa.Array) -> pa.ListArray:
        spread = pc.replace_substring(pc.replace_substring_regex(texts, _STOP, _APART), "\n", " \n")
        return pc.split_pattern(pc.binary_join_element_wise(_START, spread, ""), " ")


class WordEncoder(Encoder):
    """Pairs with word ends: white space only separates."""

    def starts(self, ids: np.ndarray) -> np.ndarray:
        return np.append(0, np.flatnonzero(self.edge("", "</w>")[ids]) + 1)[:-1]

    def cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(pc.replace_substring_regex(texts, _STOP, _APART), "\n", " "), " ")


def encoder(path: str, kind: type[Encoder]) -> Encoder:
    """One for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = kind(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop the worker's vocabularies and caches, before work that does not need them."""
    _ENCODERS.clear()
