"""Substring dedup by fixed-block anchors.

Every document is cut into reference blocks of 10 words, one after the other; any window of 20 words
holds a whole one. The blocks are indexed, and all rolling windows of 10 words probe the index. A
block that is met anywhere else is extended to the 20-word windows around it, and these are compared
by 128-bit hashes with the windows around the blocks it met, so that consecutive equal windows make up
the maximal exact repeats. The first of equal windows, by document and start, stays.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from veldt.llm.bytesio import covered, mixed, windows, word_prints
from veldt.llm.common import pack_plain, pack_sorted, unpack_plain, unpack_sorted
from veldt.llm.exchange import KEY_BITS, answers, blocked, bucket_edges, in_order, member, with_nulls

WINDOW = 20
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
_ALIGNED, _TWICE = 1, 2
_OTHER = np.uint64(0xA5A5F00D5EEDC0DE)


class _Words:
    """Word hashes of a block of documents, in order of id and place."""

    def __init__(self, pdf: pd.DataFrame):
        self.ids, self.texts, self.no_id = in_order(pdf)
        self.hashes, self.counts = word_prints(self.texts)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts

    def rolling(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that lie in one document, and their hashes."""
        values = windows(self.hashes, width)
        starts = np.flatnonzero(self.doc[: len(values)] == self.doc[width - 1 :][: len(values)])
        return starts, values[starts]

    def second(self, width: int, starts: np.ndarray) -> np.ndarray:
        """Other hashes of the same windows: with the first, 128 bits."""
        return windows(mixed(self.hashes ^ _OTHER), width)[starts]

    def blocks(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and truncated keys of all rolling windows; which of them are reference blocks."""
        starts, values = self.rolling(width)
        place = starts - self.first[self.doc[starts]]
        return starts, values >> np.uint64(64 - KEY_BITS), place % width == 0


def _zip(flags: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(flags.tobytes())


def _unzip(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _indexed_and_probed(window: int, buckets: int):
    """Per block: its rolling keys, and which of them are reference blocks or occur twice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, keys, aligned = _Words(pdf).blocks(window // 2)
        order = np.argsort(keys)
        keys, aligned = keys[order], aligned[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return pd.DataFrame({"bucket": [], "block": [], "keys": [], "flags": []})
        flags = np.maximum.reduceat(aligned.astype(np.uint8), at) * np.uint8(_ALIGNED)
        flags |= (np.diff(np.append(at, len(keys))) > 1).astype(np.uint8) * np.uint8(_TWICE)
        keys = keys[at]
        edges = bucket_edges(keys, buckets, KEY_BITS)
        rows = [(b, pack_sorted(keys[x:y]), _zip(flags[x:y])) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
        return pd.DataFrame({"bucket": [r[0] for r in rows], "block": int(pdf["block"].iloc[0]), "keys": [r[1] for r in rows], "flags": [r[2] for r in rows]})

    return run


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: to each block, those of its reference blocks that occur anywhere else."""
    keys = [unpack_sorted(b) for b in pdf["keys"]]
    flags = [_unzip(b) for b in pdf["flags"]]
    every = np.sort(np.concatenate(keys))
    elsewhere = every[1:][every[1:] == every[:-1]]
    out = []
    for block, k, f in zip(pdf["block"], keys, flags, strict=True):
        own = k[(f & _ALIGNED) > 0]
        twice = (f[(f & _ALIGNED) > 0] & _TWICE) > 0
        own = own[twice | member(own, elsewhere)]
        if len(own):
            out.append((block, pack_sorted(own)))
    return pd.DataFrame({"block": [x[0] for x in out], "keys": [x[1] for x in out]})


def _extended(window: int, buckets: int):
    """Per block: fingerprints of all windows around blocks that were met, each with its least id."""

    def run(docs: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"bucket": [], "block": [], "prints": [], "seconds": [], "ids": []})
        if not len(docs) or not len(met):
            return none
        words = _Words(docs)
        starts, keys, aligned = words.blocks(window // 2)
        blocks = starts[aligned]
        blocks = blocks[member(keys[aligned], answers(met))]
        place, prints = words.rolling(window)
        # a window holds the block at p if it starts from p - window / 2 to p
        low = np.maximum(blocks - window // 2, 0)
        near = _between(low, blocks, len(words.hashes))
        picked = near[place]
        place, prints = place[picked], prints[picked]
        if not len(place):
            return none
        seconds = words.second(window, place)
        order = np.lexsort((seconds, prints))  # stable: the first of equals has the least id
        prints, seconds = prints[order], seconds[order]
        new = np.ones(len(prints), bool)
        new[1:] = (prints[1:] != prints[:-1]) | (seconds[1:] != seconds[:-1])
        prints, seconds, ids = prints[new], seconds[new], words.ids[words.doc[place[order[new]]]].view(np.uint64)
        edges = bucket_edges(prints, buckets, 64)
        rows = [
            (b, pack_sorted(prints[x:y]), pack_plain(seconds[x:y]), pack_plain(ids[x:y]))
            for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y
        ]
        out = {n: [r[i] for r in rows] for i, n in enumerate(("bucket", "prints", "seconds", "ids"))}
        return pd.DataFrame(out).assign(block=int(docs["block"].iloc[0]))[list(none.columns)]

    return run


def _between(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, low, 1)
    np.add.at(step, high + 1, -1)
    return np.cumsum(step)[:n] > 0


def _earlier(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: to each block, those of its windows that a smaller id elsewhere has; all 128 bits are compared."""
    prints = [unpack_sorted(b) for b in pdf["prints"]]
    every, seconds = np.concatenate(prints), np.concatenate([unpack_plain(b) for b in pdf["seconds"]])
    ids = np.concatenate([unpack_plain(b).view(np.int64) for b in pdf["ids"]])
    order = np.lexsort((ids, seconds, every))
    new = np.ones(len(order), bool)
    new[1:] = (every[order][1:] != every[order][:-1]) | (seconds[order][1:] != seconds[order][:-1])
    least = np.empty(len(order), np.int64)
    least[order] = ids[order][new][np.cumsum(new) - 1]
    out, at = [], 0
    for block, p in zip(pdf["block"], prints, strict=True):
        own = p[least[at : at + len(p)] < ids[at : at + len(p)]]
        at += len(p)
        if len(own):
            out.append((block, pack_sorted(np.unique(own))))
    return pd.DataFrame({"block": [x[0] for x in out], "keys": [x[1] for x in out]})


def _kept(window: int, with_text: bool):
    """Per block: what stays of each document."""

    def run(docs: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        words = _Words(docs)
        place, prints = words.rolling(window)
        order = np.argsort(prints, kind="stable")
        value, row = prints[order], words.doc[place[order]]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        new_row = new.copy()
        new_row[1:] |= row[1:] != row[:-1]
        least = words.ids[row][new][np.cumsum(new) - 1] if len(value) else words.ids[:0]
        stays = new_row & (words.ids[row] == least) & ~member(value, answers(earlier))
        gone = covered(place[order[~stays]], window, len(words.hashes))
        removed = np.bincount(words.doc[gone], minlength=len(words.ids))
        digests, texts = [], []
        for i, text in enumerate(words.texts):
            own = text.split()
            if removed[i]:
                own = compress(own, (~gone[words.first[i] : words.first[i] + words.counts[i]]).tolist())
            left = b" ".join(own)
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                texts.append(left.decode("utf-8", "replace"))
        out = pd.DataFrame({"doc_id": words.ids, "no_id": words.no_id, "n_words": words.counts, "n_removed": removed, "kept_sha256": digests})
        return out.assign(kept_text=texts) if with_text else out

    return run


def without_repeats(
    docs: DataFrame, window: int = WINDOW, with_text: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Documents without the words of `window`-word passages that started earlier.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_words, n_removed, kept_sha256
    and, with_text, kept_text: the kept words joined by one blank. Earlier is a smaller doc_id, or an
    earlier start in the same document; windows are judged on the input. A null text counts as
    empty: no words, the digest of nothing. Rows that share a doc_id are documents of their own of
    which neither is the earlier. Texts are taken whole; one must fit in a task. `window` is even.
    An empty table gives no rows.

    Windows of different documents are compared by 128 bits of two hashes, of words that are hashed by
    XXH3 and mixed in full at every step; windows inside one block of documents by 64 of them.
    """
    rows, _, buckets = blocked(docs, block_bytes, bucket_bytes)
    sent = rows.groupBy("block").applyInPandas(_indexed_and_probed(window, buckets), "bucket int, block int, keys binary, flags binary")
    met = sent.groupBy("bucket").applyInPandas(_met, "block int, keys binary")
    asked = rows.groupBy("block").cogroup(met.groupBy("block")).applyInPandas(
        _extended(window, buckets), "bucket int, block int, prints binary, seconds binary, ids binary"
    )
    earlier = asked.groupBy("bucket").applyInPandas(_earlier, "block int, keys binary")
    schema = "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    return with_nulls(rows.groupBy("block").cogroup(earlier.groupBy("block")).applyInPandas(_kept(window, with_text), schema))
