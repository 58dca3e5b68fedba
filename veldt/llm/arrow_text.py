"""Text columns of Arrow batches as plain buffers; hashes and equality of the words in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from veldt.llm.bytesio import mixed

#: words of more bytes than this are hashed and compared one by one
LONG = 64

_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: int, bound: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `bound` bytes of text each, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + bound, side="right")))
        yield batch.slice(at, end - at)
        at = end


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and where each begins, and the last ends; null is empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    buffer = np.frombuffer(data, np.uint8, int(edges[-1]))[edges[0] :] if data is not None and edges[-1] else np.zeros(0, np.uint8)
    return buffer, edges - edges[0]


def _lanes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, their next 8 bytes as a number) for all words that have any left, up to LONG bytes."""
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    at = np.flatnonzero(sizes <= LONG)
    for done in range(0, LONG, 8):
        at = at[sizes[at] > done]
        if not len(at):
            return
        yield at, words[starts[at] + done] & _MASKS[np.minimum(sizes[at] - done, 8)]


def word_hashes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = sizes.astype(np.uint64) * _STEP
    for at, lane in _lanes(buffer, starts, sizes):
        out[at] = mixed(out[at] * _STEP + lane)
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : starts[i] + sizes[i]].tobytes())
    return out


def equal_words(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the words at a and b, of the same sizes, are equal."""
    out = np.ones(len(a), bool)
    for (at, left), (_, right) in zip(_lanes(buffer, a, sizes), _lanes(buffer, b, sizes), strict=True):
        out[at] &= left == right
    for i in np.flatnonzero(sizes > LONG).tolist():
        n = sizes[i]
        out[i] = np.array_equal(buffer[a[i] : a[i] + n], buffer[b[i] : b[i] + n])
    return out
