"""Hashes of words and of windows of words, for many texts at once.

A word's hash is a polynomial in its bytes, a window's one in its words' hashes, both modulo 2^64 and mixed: equal
words give equal hashes everywhere, and different ones differ but for one chance in 2^64.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Bytes that part words: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C55, 0xD1342543DE82EF95
#: Bytes of text hashed at a time; one longer text counts as a portion of its own.
PORTION = 1 << 19


class Words(NamedTuple):
    """The words of several texts, one after the other."""

    hashes: np.ndarray
    #: where each word starts and ends in ``data``
    starts: np.ndarray
    ends: np.ndarray
    #: text i has the words offsets[i] to offsets[i + 1]
    offsets: np.ndarray
    data: bytes


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit integers over the others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, size.bit_length()))


def forget_powers() -> None:
    """Give back what ``powers`` keeps, 18 MB or more: a worker that has ended its task may go on with other work."""
    _powers.cache_clear()


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of the first n values, each times its power of the base."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """The words of the texts, in order."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    sums = _sums((_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1), _BYTE_BASE)
    inverse = powers(_BYTE_BASE, len(raw) + 1)[1]
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    return Words(hashes, starts, ends, offsets, data)


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a text, and the number of the word where each begins."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(words.offsets[1:], np.diff(words.offsets)) - np.arange(n)
    at = np.flatnonzero(left >= size)
    sums = _sums(words.hashes, _WORD_BASE)
    inverse = powers(_WORD_BASE, n + 1)[1]
    return mix((sums[at + size] - sums[at]) * inverse[at] + np.uint64(size)), at


def portions(texts: list[bytes], most: int = PORTION):
    """Ranges of ``texts`` of about ``most`` bytes, with at least one text in each."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Per text its different shingles, sorted: windows of ``size`` words, or all its words if they are fewer."""
    words = words_of(texts, lower=True)
    found, at = windows(words, size)
    counts = np.diff(words.offsets)
    firsts = np.searchsorted(at, words.offsets)
    out = []
    for i, n in enumerate(counts):
        if n >= size:
            out.append(np.unique(found[firsts[i] : firsts[i + 1]]))
        elif n:
            own = Words(words.hashes[words.offsets[i] : words.offsets[i + 1]], words.starts, words.ends, np.array([0, n]), b"")
            out.append(windows(own, int(n))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
