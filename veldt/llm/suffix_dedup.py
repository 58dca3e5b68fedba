"""Suffix-array dedup with a run-length index.

Every window of 50 bytes chooses an anchor, its least 20-byte hash. Equal windows choose equal
anchors, so only passages around anchors that another document has can be repeats. These passages
meet in bins by anchor. A bin builds a run-compressed Burrows-Wheeler transform of its distinct
passages, streams the passages' matching statistics through it, and where the match from a place on
is 50 bytes or longer, the place is marked if a document with a smaller id has these bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame

from veldt.llm.bytesio import CHUNK, covered, gram_codes, joined, mixed, owner
from veldt.llm.common import pack_plain, pack_sorted, unpack_plain, unpack_sorted
from veldt.llm.exchange import KEY_BITS, answers, blocked, bucket_edges, in_order, member, pieces, with_nulls
from veldt.llm.runindex import RunIndex

DEPTH = 50
GRAM = 20
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
BIN_BYTES = 2 << 20
#: bytes of passages under one index: a bin is cut between anchors, for memory and speed
INDEX_BYTES = 1 << 18


class _Anchors:
    """Anchors of a block: for each run of windows with one anchor, its first and last window.

    Anchors are least hashes, so their keys are hashed once more: otherwise most would lie in the
    first buckets and bins.
    """

    def __init__(self, pdf: pd.DataFrame, depth: int = DEPTH, gram: int = GRAM):
        self.ids, self.texts, self.no_id = in_order(pdf)
        self.buffer, self.starts, self.ends = joined(self.texts)
        self.depth = depth
        width = depth - gram + 1
        parts = []
        n = len(self.buffer) - depth
        last_start = self.ends - depth  # of each document; windows may start up to here
        for low in range(0, max(n, 0), CHUNK):
            high = min(low + CHUNK, n)
            hashes = gram_codes(self.buffer[low : high + depth - 1], gram)
            # the hash above, the place below: the least is the leftmost of the least
            packed = (hashes >> np.uint64(22) << np.uint64(22)) | np.arange(len(hashes), dtype=np.uint64)
            size = 1
            while size * 2 <= width:
                packed = np.minimum(packed[:-size], packed[size:])
                size *= 2
            if size < width:
                packed = np.minimum(packed[: len(packed) - (width - size)], packed[width - size :])
            packed = packed[: high - low]
            begin = np.arange(low, low + len(packed))
            doc = owner(self.starts, begin)
            good = begin <= last_start[doc]
            place = (packed & np.uint64((1 << 22) - 1)).astype(np.int64)
            begin, place, doc = begin[good], place[good], doc[good]
            new = np.ones(len(begin), bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            if len(at):
                parts.append((begin[at], begin[np.append(at[1:], len(begin)) - 1], mixed(hashes[place[at]]) >> np.uint64(64 - KEY_BITS), doc[at]))
        if parts:
            self.first, self.last, self.keys, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.keys = np.zeros(0, np.uint64)

    def passages(self, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """XXH3 fingerprint of the bytes of all windows of each run."""
        whole, digest = self.buffer.tobytes(), xxhash.xxh3_64_intdigest
        first, end = self.first[which].tolist(), (self.last[which] + self.depth).tolist()
        return np.fromiter((digest(whole[a:b]) for a, b in zip(first, end, strict=True)), np.uint64, len(first))


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unzip(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _anchored(buckets: int):
    """Per block: its anchors' keys, apart those that two of its documents have."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors = _Anchors(pdf)
        none = pd.DataFrame({"bucket": [], "block": [], "keys": [], "flags": []})
        if not len(anchors.keys):
            return none
        order = np.argsort(anchors.keys, kind="stable")
        keys, doc = anchors.keys[order], anchors.doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(new)
        shared = (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)).astype(np.uint8)
        keys = keys[at]
        edges = bucket_edges(keys, buckets, KEY_BITS)
        rows = [(b, pack_sorted(keys[x:y]), _zip(shared[x:y].tobytes())) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if x < y]
        return pd.DataFrame({"bucket": [r[0] for r in rows], "block": int(pdf["block"].iloc[0]), "keys": [r[1] for r in rows], "flags": [r[2] for r in rows]})

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per bucket: to each block, those of its keys that two documents have."""
    keys = [unpack_sorted(b) for b in pdf["keys"]]
    inside = [k[_unzip(f) > 0] for k, f in zip(keys, pdf["flags"], strict=True)]
    every = np.sort(np.concatenate(keys))
    known = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *inside]))
    out = [(block, pack_sorted(own)) for block, k in zip(pdf["block"], keys, strict=True) if len(own := k[member(k, known)])]
    return pd.DataFrame({"block": [x[0] for x in out], "keys": [x[1] for x in out]})


def _passages(bins: int):
    """Per block: its distinct passages around shared anchors, with the least id that has each."""

    def run(docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("bin", "block", "keys", "prints", "ids", "sizes", "bytes")})
        if not len(docs) or not len(shared):
            return none
        anchors = _Anchors(docs)
        used = np.flatnonzero(member(anchors.keys, answers(shared)))
        prints = anchors.passages(used)
        _, at = np.unique(prints, return_index=True)  # the first: documents are in order of id
        used, prints = used[at], prints[at]
        order = np.argsort(anchors.keys[used], kind="stable")
        used, prints = used[order], prints[order]
        keys = anchors.keys[used]
        edges = bucket_edges(keys, bins, KEY_BITS)
        whole = anchors.buffer.tobytes()
        rows = []
        for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if x < y:
                first, end = anchors.first[used[x:y]].tolist(), (anchors.last[used[x:y]] + anchors.depth).tolist()
                text = b"".join([whole[i:j] for i, j in zip(first, end, strict=True)])
                sizes = (anchors.last - anchors.first)[used[x:y]].astype(np.uint8)
                rows.append((b, pack_sorted(keys[x:y]), prints[x:y].tobytes(), pack_plain(anchors.ids[anchors.doc[used[x:y]]].view(np.uint64)), sizes.tobytes(), _zip(text)))
        names = ("bin", "keys", "prints", "ids", "sizes", "bytes")
        return pd.DataFrame({n: [r[i] for r in rows] for i, n in enumerate(names)}).assign(block=int(docs["block"].iloc[0]))[list(none.columns)]

    return run


def _portions(keys: np.ndarray, sizes: np.ndarray, most: int = INDEX_BYTES) -> list[slice]:
    """Runs of passages, whole anchors each, of about `most` bytes."""
    if not len(keys):
        return []
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    ends = np.cumsum(sizes)
    number = (ends[first] - sizes[first]) // most  # of an anchor's first passage
    cuts = [*first[np.append(True, number[1:] != number[:-1])].tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _same(a: np.ndarray, b: np.ndarray, prints: np.ndarray, begin: np.ndarray, sizes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether passages a[i] and b[i] are the same bytes; bytes are compared where the fingerprints agree."""
    same = (prints[a] == prints[b]) & (sizes[a] == sizes[b])
    at = np.flatnonzero(same)
    for part in np.array_split(at, max(1, int(sizes[a[at]].sum()) >> 22)):
        if not len(part):
            continue
        size = sizes[a[part]]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        equal = text[np.repeat(begin[a[part]], size) + step] == text[np.repeat(begin[b[part]], size) + step]
        same[part] = np.logical_and.reduceat(equal, first)
    return same


def _mark(many, own, sizes, begin, text, least, marks, depth) -> None:
    """Index some passages and set the bits of the windows that a smaller id has."""
    size, first = sizes[own[many]], begin[own[many]]
    end = np.cumsum(size + 1) - 1
    start = end - size
    buffer = np.zeros(int(end[-1]) + 1, np.uint8)
    inside = np.ones(len(buffer), bool)
    inside[end] = False
    buffer[inside] = text[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    index = RunIndex(buffer, start, end, least[many], depth)
    for who, place, row, _, length in index.stream(start, end, buffer):
        hit = np.flatnonzero((end[who] - place >= depth) & (length >= depth))
        smaller = hit[index.least_label(row[hit]) < least[many[who[hit]]]]
        offset = (place[smaller] - start[who[smaller]]).astype(np.uint64)
        marks[many[who[smaller]]] |= np.uint64(1) << offset


def _marked(depth: int):
    """Per bin: to each block, which windows of its passages a smaller id has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_sorted(b) for b in pdf["keys"]])
        prints = np.concatenate([np.frombuffer(b, np.uint64) for b in pdf["prints"]])
        ids = np.concatenate([unpack_plain(b).view(np.int64) for b in pdf["ids"]])
        sizes = np.concatenate([np.frombuffer(b, np.uint8) for b in pdf["sizes"]]).astype(np.int64) + depth
        text = np.concatenate([_unzip(b) for b in pdf["bytes"]])
        counts = [len(b) // 8 for b in pdf["prints"]]
        begin = np.cumsum(sizes) - sizes
        # one passage for each fingerprint, that with the least id
        order = np.lexsort((ids, prints))
        new = np.ones(len(order), bool)
        new[1:] = ~_same(order[:-1], order[1:], prints, begin, sizes, text)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        own = order[new]
        least = ids[own]
        marks = np.zeros(len(own), np.uint64)
        # a passage that is alone under its anchor shares no window with another
        anchor, back, times = np.unique(keys[own], return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[back] > 1)
        many = many[np.argsort(keys[own[many]], kind="stable")]
        for part in _portions(keys[own[many]], sizes[own[many]]):
            _mark(many[part], own, sizes, begin, text, least, marks, depth)
        full = (np.uint64(1) << (sizes - depth + 1).astype(np.uint64)) - np.uint64(1)
        each = np.where(ids > least[number], full, marks[number])
        out, at = [], 0
        for block, n in zip(pdf["block"], counts, strict=True):
            part = np.flatnonzero(each[at : at + n]) + at
            part = part[np.argsort(prints[part])]
            if len(part):
                out.append((block, prints[part].tobytes(), pack_plain(each[part])))
            at += n
        return pd.DataFrame({"block": [x[0] for x in out], "prints": [x[1] for x in out], "marks": [x[2] for x in out]})

    return run


def _kept(with_text: bool):
    """Per block: what stays of each document."""

    def run(docs: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        anchors = _Anchors(docs)
        prints = anchors.passages()
        known = np.concatenate([np.frombuffer(b, np.uint64) for b in marked["prints"]]) if len(marked) else np.zeros(0, np.uint64)
        marks = np.concatenate([unpack_plain(b) for b in marked["marks"]]) if len(marked) else np.zeros(0, np.uint64)
        order = np.argsort(known)
        known, marks = known[order], marks[order]
        mask = np.zeros(len(prints), np.uint64)
        has = member(prints, known)
        mask[has] = marks[np.searchsorted(known, prints[has])]
        # the passages of a block stand for their least id; for any other all windows are repeats
        by = np.argsort(prints, kind="stable")
        new = np.ones(len(by), bool)
        new[1:] = prints[by][1:] != prints[by][:-1]
        least = anchors.ids[anchors.doc[by]][new][np.cumsum(new) - 1] if len(by) else anchors.ids[:0]
        later = np.zeros(len(prints), bool)
        later[by] = anchors.ids[anchors.doc[by]] > least
        full = (np.uint64(1) << (anchors.last - anchors.first + 1).astype(np.uint64)) - np.uint64(1)
        mask[later] = full[later]
        gone = np.flatnonzero(mask)
        place = []
        for bit in range(int((anchors.last - anchors.first).max(initial=-1)) + 1):
            on = gone[(mask[gone] >> np.uint64(bit)) & np.uint64(1) > 0]
            place.append(anchors.first[on] + bit)
        place = np.concatenate(place) if place else np.zeros(0, np.int64)
        out = covered(place, anchors.depth, len(anchors.buffer))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])) == 1)
        spans = np.bincount(owner(anchors.starts, edge), minlength=len(anchors.ids)) if len(anchors.ids) else []
        sums = np.concatenate([[0], np.cumsum(out)])
        removed = sums[anchors.ends] - sums[anchors.starts]
        digests, texts = [], []
        for i, text in enumerate(anchors.texts):
            left = text
            if removed[i]:
                own = slice(anchors.starts[i], anchors.ends[i])
                left = anchors.buffer[own][~out[own]].tobytes()
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                texts.append(left)
        frame = pd.DataFrame({"doc_id": anchors.ids, "no_id": anchors.no_id, "n_bytes": anchors.ends - anchors.starts, "n_removed": removed, "n_spans": spans, "kept_sha256": digests})
        return frame.assign(kept=texts) if with_text else frame

    return run


def without_repeated_bytes(
    docs: DataFrame, with_text: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, bin_bytes: int = BIN_BYTES
) -> DataFrame:
    """Documents without the bytes that a 50-byte string of a document with a smaller id covers.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, with_text, kept: the remaining bytes. Strings are
    judged on the input, overlaps count, and none crosses documents. A null text counts as empty.
    Rows that share a doc_id never remove each other's bytes, nor do rows without one, which come after
    all ids under 2**63 - 1. Texts are taken whole; one must fit in a task. An empty table gives no rows.

    Passages meet by 64-bit XXH3 fingerprints; where two blocks' fingerprints agree, bytes are compared.
    Only passages of one block of documents (4 MB up to 1 GB of text, then growing with its root) are taken as equal by fingerprint alone.
    """
    rows, total, buckets = blocked(docs, block_bytes, bucket_bytes)
    bins = max(48, pieces(total, bin_bytes))
    sent = rows.groupBy("block").applyInPandas(_anchored(buckets), "bucket int, block int, keys binary, flags binary")
    shared = sent.groupBy("bucket").applyInPandas(_shared, "block int, keys binary")
    passages = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(
        _passages(bins), "bin int, block int, keys binary, prints binary, ids binary, sizes binary, bytes binary"
    )
    marked = passages.groupBy("bin").applyInPandas(_marked(DEPTH), "block int, prints binary, marks binary")
    schema = "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return with_nulls(rows.groupBy("block").cogroup(marked.groupBy("block")).applyInPandas(_kept(with_text), schema))
