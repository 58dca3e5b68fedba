"""Vectorised numbering and hashing of bytes, words and word windows over blocks of documents (numpy)."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: bytes handled at once: working arrays stay in a core's cache
CHUNK = 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _LEFT)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all texts, a blank after each; where each starts; where it ends."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
    return buffer, ends - sizes, ends


def word_spans(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ASCII white space."""
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = ~_WHITE[buffer]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_numbers(texts: list[bytes]) -> np.ndarray:
    """A number for each word of all texts, in order: equal words, and only these, have the same."""
    table: dict[bytes, int] = {}
    number = table.setdefault
    return np.array([number(w, len(table)) for t in texts for w in t.split()], np.int64)


def pair_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]): equal pairs, and only these, have the same."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def word_prints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """XXH3 hash of each word of all texts, in order, and the number of words of each text.

    Each distinct word is hashed once.
    """
    table: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    for words in split:
        for w in set(words).difference(table):
            table[w] = xxhash.xxh3_64_intdigest(w)
    number = table.__getitem__
    counts = np.fromiter(map(len, split), np.int64, len(split))
    return np.fromiter(chain.from_iterable(map(number, words) for words in split), np.uint64, int(counts.sum())), counts


def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs, not linear in either side and not symmetric."""
    return mixed(mixed(a + _LEFT) * _RIGHT + b)


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values; len(values) - width + 1 of them.

    Runs of 1, 2, 4 .. values are hashed from two halves, and a width from its binary parts; every
    step is a full 64-bit mix, so runs that repeat or complement a pattern don't cancel out.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, block, out, done = 1, values, None, 0
    while True:
        if width & size:
            part = block[done : done + n]
            out = part if out is None else joint(out, part)
            done += size
        if size * 2 > width:
            return mixed(out)
        block = joint(block[:-size], block[size:])
        size *= 2


def gram_codes(buffer: np.ndarray, width: int) -> np.ndarray:
    """A cheap code of each run of `width` bytes, to choose places by; it never decides equality."""
    n = len(buffer) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size, block, out, done = 1, _BYTE_CODES[buffer], None, 0
    while True:
        if width & size:
            part = block[done : done + n]
            out = part if out is None else out * _LEFT + part
            done += size
        if size * 2 > width:
            return mixed(out)
        block = (block[:-size] ^ (block[:-size] >> np.uint64(29))) * _LEFT + block[size:]
        size *= 2


def owner(starts: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the document that holds each position."""
    return np.searchsorted(starts, positions, side="right") - 1


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for a start s."""
    if not len(starts):
        return np.zeros(n, bool)
    step = np.zeros(n + width + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step)[:n] > 0
