"""Words of many texts at once, as arrays: where they begin and end, and a 64-bit hash of each."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240101)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: 1: an ASCII letter, 2: ASCII punctuation other than an apostrophe.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[c for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)) if c != 0x27]] = 2
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            with np.errstate(over="ignore"):
                _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts (null: none); with ``plain``, ASCII punctuation parts words too.
    With ``letters``, a word also ends between an ASCII letter and ASCII punctuation other than an apostrophe.

    ``start``, ``end``: byte offsets into ``data``; ``hash``: of the bytes; ``first``: for each text
    the index of its first word, with one more entry at the end.
    """

    def __init__(self, texts: list[str | None], lower: bool = True, plain: bool = False, letters: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(raw)
        if lower:
            self.data = self.data.lower()
        b = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~(_PUNCT if plain else _SPACE)[b]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if letters and len(b):
            kind = _KIND[b]
            inner = np.flatnonzero(kind[1:] * kind[:-1] == 2) + 1
            self.start, self.end = (np.sort(np.concatenate([x, inner])) for x in (self.start, self.end))
        up, down = _powers(len(b) + 1)
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * up[: len(b)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the text each belongs to.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    weight = mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    counts = np.diff(words.first)
    of = np.repeat(np.arange(len(counts)), counts)
    value = np.zeros(n, np.uint64)
    reach = words.first[1:][of]
    at = np.arange(n)
    for j in range(width):
        ok = at + j < reach
        value[ok] += words.hash[at[ok] + j] * weight[j]
    whole = (at + width <= reach) | ((counts[of] < width) & (at == words.first[:-1][of]))
    value, of = mix(value[whole] + np.minimum(counts[of[whole]], width).astype(np.uint64)), of[whole]
    cuts = np.searchsorted(of, np.arange(len(counts) + 1))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]


def slices(texts: list, chars: int = 1_000_000, size=lambda t: len(t or "")) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many characters: what is in memory at once does not grow with a batch."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        n += size(t)
        if n >= chars:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def text_slices(column: pa.Array, size: int = 1_000_000) -> Iterator[tuple[int, int, list]]:
    """Runs of rows of about so many bytes, ``first, end, values``: only one run at a time becomes Python objects.

    After the last one, freed memory goes back to the system, for the worker that did this may stay idle beside others.
    """
    for a, b in slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), size, int):
        yield a, b, column.slice(a, b - a).to_pylist()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
