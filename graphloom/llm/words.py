"""Words of UTF-8 texts, found and hashed with numpy over a whole chunk of texts.

A word is a longest run of digits, letters and characters past U+007F; A-Z count as a-z. In UTF-8 that is a
property of single bytes, so bytes are enough: [0-9A-Za-z\\x80-\\xff]+.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[65:91] = word[128:] = True
    value = mix(low.astype(_U) + _U(1))
    return low, word, value


LOW, WORD, VALUE = _tables()
_power = np.ones(1, _U)
_unpower = np.ones(1, _U)


def _grow(n: int) -> None:
    global _power, _unpower
    if len(_power) < n:
        with np.errstate(over="ignore"):
            size = 1 << (n - 1).bit_length()
            _power = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _PRIME, _U)]))
            _unpower = np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, _INVERSE, _U)]))


@dataclass
class Words:
    """Words in order. doc: the text's number in the chunk; start, end: byte offsets in the chunk."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: First word of each text, and the number of words at the end.
    first: np.ndarray
    sums: np.ndarray

    def prefix(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and hashes of the words of more than length bytes, by their first bytes alone."""
        at = np.flatnonzero(self.end - self.start > length)
        s = self.start[at]
        return at, _span(self.sums, s, s + length)


def _span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _unpower[start] + (end - start).astype(_U))


def split(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]."""
    n = len(data)
    _grow(n + 1)
    inside = WORD[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[edges] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum(VALUE[data] * _power[:n], out=sums[1:])
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(doc, start, end, _span(sums, start, end), first, sums)


def hashed(word: bytes) -> int:
    """The hash that split() gives this word."""
    data = np.frombuffer(word, np.uint8)
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(VALUE[data] * _power[: len(data)], out=sums[1:])
    return int(_span(sums, np.array([0]), np.array([len(data)]))[0])


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of size words in a row, number of the text). A text of fewer words, but not none, has one: all its words."""
    n = np.diff(w.first)
    h = np.zeros(len(w.hash), _U)
    if len(h) >= size:
        k = len(h) - size + 1
        for i in range(size):
            h[:k] = mix(h[:k] + w.hash[i : i + k]) if i else mix(w.hash[:k])
    at = np.flatnonzero(np.arange(len(h)) + size <= w.first[w.doc + 1]) if len(h) else np.zeros(0, np.int64)
    out, doc = h[at], w.doc[at]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.empty(len(short), _U)
        for j, d in enumerate(short):
            x = mix(w.hash[w.first[d] : w.first[d] + 1])
            for i in range(1, n[d]):
                x = mix(x + w.hash[w.first[d] + i : w.first[d] + i + 1])
            extra[j] = mix(x + _U(int(n[d])))[0]
        out, doc = np.concatenate([out, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


class HashIndex:
    """Sorted 64-bit hashes with a table over their first bits; looks up whole arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys.astype(_U))
        self.bits = max(8, min(22, int(len(self.keys)).bit_length() + 4))
        self.some = np.zeros(1 << self.bits, bool)
        self.some[(self.keys >> _U(64 - self.bits)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h that are keys, numbers of those keys)"""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.some[(h >> _U(64 - self.bits)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]
