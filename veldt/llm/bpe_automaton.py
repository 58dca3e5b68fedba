"""Byte-level BPE as a deterministic automaton over tokens, compiled from the merges.

A sequence of tokens is what BPE makes of its text exactly if every token may follow the one before
it. The automaton that accepts these sequences, and no others, is built merge by merge. At first every
byte leads back to the one state. The gadget of a merge (u, v) gives u a state of its own, a copy of
the one it led to but without the arc v; and wherever u may go, the new token uv may go, to
the state that v led to. So a state is a copy of an earlier one less one arc, and the states form a tree;
and as a merge takes the arc v out of one state only, the arcs' kinds (those that leave the same states)
form a tree as well. After all merges, a state lacks an arc exactly if some merge made an
ancestor of both. Numbered by depth first, all that a merge takes out is a rectangle, and the table of
transitions is the states left in use by the kinds left in use, one bit each.

A pre-split word is encoded from left to right: from the state at a position, every token that reads on
from there along the trie of the vocabulary and is an arc of the state sets the state after it. As exactly
one sequence of tokens is accepted for each prefix, no position is set twice. Decoding emits the labels of
the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.arrow_text import buffer_of, equal_words, slices, word_hashes
from veldt.llm.bytesio import mixed

#: fixed values: how text is cut into words before any merge
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: words of up to this many bytes are encoded together
TOGETHER = 32


def letters_of_bytes() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Tree:
    """Versions of states, or of kinds of arcs; version m is made by merge m, the root is 0."""

    def __init__(self, merges: int):
        self.parent = np.full(merges + 1, -1, np.int64)
        self.parent[0] = 0

    def ancestors(self, version: int) -> Iterator[int]:
        while version:
            yield version
            version = int(self.parent[version])

    def numbered(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depth-first numbers of the live versions, and for every version the range of its live descendants."""
        made = np.flatnonzero(self.parent >= 0)
        below = np.zeros(len(self.parent), np.int64)
        below[live] = 1
        for m in made[:0:-1].tolist():  # children are made after their parents
            below[self.parent[m]] += below[m]
        first = np.zeros(len(self.parent), np.int64)
        taken = np.zeros(len(self.parent), np.int64)
        is_live = np.zeros(len(self.parent), np.int64)
        is_live[live] = 1
        taken[0] = is_live[0]
        for m in made[1:].tolist():
            p = self.parent[m]
            first[m] = first[p] + taken[p]
            taken[p] += below[m]
            taken[m] = is_live[m]
        return first, first, first + below


class Automaton:
    """Tables of a vocabulary: trie over bytes, state and kind of each token, missing transitions."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None):
        byte_of = letters_of_bytes()
        self.special = dict(special or {})
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * size
        for text, i in vocabulary.items():
            self.labels[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
        for text, i in self.special.items():
            self.labels[i] = text.encode()
        states, kinds = _Tree(len(merges)), _Tree(len(merges))
        to, kind = np.full(size, -1, np.int64), np.full(size, -1, np.int64)  # version of each token's state and kind
        for b in byte_of:
            if b not in vocabulary:
                raise ValueError("a byte-level vocabulary holds all bytes")
            to[vocabulary[b]] = kind[vocabulary[b]] = 0
        for m, (left, right) in enumerate(merges, 1):
            u, v, w = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if to[u] < 0 or to[v] < 0 or not set(states.ancestors(int(to[u]))).isdisjoint(kinds.ancestors(int(kind[v]))):
                continue  # no text leads to u and then v
            if to[w] >= 0:
                raise ValueError("two merges make the same token")
            states.parent[m], kinds.parent[m] = to[u], kind[v]
            after = to[v]
            to[u], kind[v] = m, m
            to[w], kind[w] = after, kind[u]
        self.tokens = np.flatnonzero(to >= 0)
        self._tables(states, kinds, to, kind)

    def _tables(self, states: _Tree, kinds: _Tree, to: np.ndarray, kind: np.ndarray) -> None:
        live_states, live_kinds = (np.unique(np.append(x[self.tokens], 0)) for x in (to, kind))
        number, low, high = kinds.numbered(live_kinds)
        width = len(live_kinds)
        # a state lacks what its parent lacks and what its own merge took out
        lacks: dict[int, np.ndarray] = {0: np.zeros(width, bool)}
        wanted = np.zeros(len(states.parent), bool)
        for s in live_states[::-1].tolist():
            while s and not wanted[s]:
                wanted[s] = True
                s = int(states.parent[s])
        children = np.bincount(states.parent[np.flatnonzero(wanted)], minlength=len(states.parent))
        packed = np.zeros((len(live_states), -(-width // 8)), np.uint8)
        place = {int(s): i for i, s in enumerate(live_states)}
        for s in [0, *np.flatnonzero(wanted).tolist()]:
            if s:
                p = int(states.parent[s])
                lacks[s] = lacks[p].copy()
                lacks[s][low[s] : high[s]] = True
                children[p] -= 1
                if not children[p]:
                    del lacks[p]
            if s in place:
                packed[place[s]] = np.packbits(lacks[s], bitorder="little")
            if not children[s]:
                lacks.pop(s, None)
        self.lacking, same = np.unique(packed, axis=0, return_inverse=True)  # equal states are one
        same = same.ravel()
        size = len(self.labels)
        self.state, self.kind = np.zeros(size, np.int32), np.zeros(size, np.int32)
        self.state[self.tokens] = [same[place[int(s)]] for s in to[self.tokens]]
        self.kind[self.tokens] = number[kind[self.tokens]]
        self.start = int(same[place[0]])

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """The automaton of a tokenizer file: byte-level BPE without a normalizer."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"]
        plain = not spec["normalizer"] and cut["type"] == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True)
        if not plain or model.get("type", "BPE") != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level BPE tokenizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look around them are not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("trie", "sizes", "_plain", "_cut")}

    @cached_property
    def sizes(self) -> np.ndarray:
        """Bytes of each token."""
        return np.array([len(label) for label in self.labels])

    @cached_property
    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash table from node * 256 + byte to the next node; the token that ends at each node, or -1."""
        nodes: dict[bytes, int] = {b"": 0}
        steps: list[tuple[int, int]] = []
        for t in self.tokens.tolist():
            label = self.labels[t]
            known = len(label)
            while label[:known] not in nodes:
                known -= 1
            for i in range(known, len(label)):
                steps.append((nodes[label[:i]] << 8 | label[i], len(nodes)))
                nodes[label[: i + 1]] = len(nodes)
        ends = np.full(len(nodes), -1, np.int32)
        for t in self.tokens.tolist():
            ends[nodes[self.labels[t]]] = t
        slots = 1 << (4 * len(steps)).bit_length()
        keys, to = np.full(slots, -1, np.int64), np.full(slots, -1, np.int32)
        key, node = np.array(steps, np.int64).T
        at = _slot(key, slots)
        while len(key):
            free = keys[at] < 0
            keys[at[free]] = key[free]  # of several, one stays
            done = keys[at] == key
            to[at[done]] = node[done]
            key, node, at = key[~done], node[~done], (at[~done] + 1) & (slots - 1)
        return keys, to, ends

    @cached_property
    def _plain(self) -> tuple[dict[int, int], list[int], list[int], list[int], list[bytes]]:
        """The tables as Python's own, for one word at a time."""
        keys, to, ends = self.trie
        used = keys >= 0
        steps = dict(zip(keys[used].tolist(), to[used].tolist(), strict=True))
        return steps, ends.tolist(), self.state.tolist(), self.kind.tolist(), [r.tobytes() for r in self.lacking]

    @cached_property
    def _cut(self) -> regex.Pattern | None:
        longest = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def word(self, data: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        steps, ends, state, kind, rows = self._plain
        n = len(data)
        at, back = [-1] * (n + 1), [0] * (n + 1)
        at[0] = self.start
        for i in range(n):
            row, node = rows[at[i]], 0
            for j in range(i, n):
                node = steps.get(node << 8 | data[j], -1)
                if node < 0:
                    break
                token = ends[node]
                if token >= 0 and at[j + 1] < 0 and not row[kind[token] >> 3] >> (kind[token] & 7) & 1:
                    at[j + 1], back[j + 1] = state[token], token
        out, i = [], n
        while i:
            out.append(back[i])
            i -= len(self.labels[back[i]])
        return out[::-1]

    def many(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pre-split words, one behind the other, and the number of each word's.

        Words of up to TOGETHER bytes take every step together; longer ones one after the other.
        """
        order = np.argsort(-sizes, kind="stable")
        longer = int((sizes > TOGETHER).sum())
        ids, counts = self._together(buffer, starts[order[longer:]], sizes[order[longer:]])
        alone = [self.word(buffer[starts[i] : starts[i] + sizes[i]].tobytes()) for i in order[:longer].tolist()]
        n = np.empty(len(order), np.int64)
        n[order] = np.append(np.array([len(x) for x in alone], np.int64), counts)
        every = np.concatenate([np.array([t for x in alone for t in x], np.int32), ids])
        first = np.empty(len(order), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return every[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n

    def _next(self, key: np.ndarray) -> np.ndarray:
        keys, to, _ = self.trie
        at = _slot(key, len(keys))
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            found = keys[at]
            hit = found == key
            out[left[hit]] = to[at[hit]]
            on = np.flatnonzero(~hit & (found >= 0))
            key, at, left = key[on], (at[on] + 1) & (len(keys) - 1), left[on]
        return out

    def _together(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of falling size."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, _, ends = self.trie
        base = np.cumsum(sizes + 1) - sizes - 1  # a place for each position of each word, its end included
        at = np.full(int(base[-1] + sizes[-1] + 1), -1, np.int32)
        back = np.zeros(len(at), np.int32)
        at[base] = self.start
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i))  # words of more than i bytes
            place, read, left = base[:n] + i, starts[:n] + i, sizes[:n] - i
            row, node = at[place], np.zeros(n, np.int64)
            while len(node):
                node = self._next(node << 8 | buffer[read])
                place, read, left = place + 1, read + 1, left - 1
                token = np.where(node >= 0, ends[node], -1)
                may = np.flatnonzero((token >= 0) & (at[place] < 0))
                kind = self.kind[token[may]]
                may = may[self.lacking[row[may], kind >> 3] >> (kind & 7).astype(np.uint8) & 1 == 0]
                at[place[may]], back[place[may]] = self.state[token[may]], token[may]
                on = np.flatnonzero((node >= 0) & (left > 0))
                row, node, place, read, left = row[on], node[on], place[on], read[on], left[on]
        used = np.zeros(len(at), bool)
        where, least = base + sizes, base
        while len(where):
            used[where] = True
            where = where - self.sizes[back[where]]
            on = where > least
            where, least = where[on], least[on]
        upto = np.append(0, np.cumsum(used))
        return back[used], upto[base + sizes + 1] - upto[base]

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Words of a text, run by run, and the added tokens between the runs."""
        parts = self._cut.split(text) if self._cut and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield _split(part)

    def decode(self, ids: list[int]) -> str:
        """Text of tokens: the labels of their arcs; what is not UTF-8 is replaced."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_split = regex.compile(SPLIT).findall


def _slot(key: np.ndarray, slots: int) -> np.ndarray:
    return (mixed(key.astype(np.uint64)) & np.uint64(slots - 1)).astype(np.int64)


#: Characters of a clean text, whose classes the bytes tell: letters, digits, blanks and marks.
_CLEAN = re.compile(r"[\t-\r\x20-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff\u2010-\u2027\u20ac]*").fullmatch
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def clean_cuts(buffer: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte, as SPLIT cuts; right for clean texts only."""
    n = len(buffer)
    kind = _CLASS[buffer]
    for lead, size in ((0xC2, 2), (0xC3, 2), (0xE2, 3)):
        at = np.flatnonzero(buffer == lead)
        if lead == 0xC3:
            after = buffer[at + 1]
            at = at[(after == 0x97) | (after == 0xB7)]  # the times and division signs
        for i in range(size):
            kind[np.minimum(at + i, n - 1)] = _MARK
    begins = np.ones(n + 1, bool)
    begins[1:-1] = kind[1:] != kind[:-1]
    begins[edges] = True
    # the last of some blanks before a word stands alone, or begins the word if it is a space
    ends = np.zeros(n + 1, bool)
    ends[edges] = True
    last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~ends[1:-1])
    begins[last] = True
    begins[last[buffer[last] == 0x20] + 1] = False
    marks = np.flatnonzero((buffer == 0x27) & begins[:-1])
    limits = edges[np.searchsorted(edges, marks, side="right")]
    whole = buffer.tobytes()
    for i, limit in zip(marks.tolist(), limits.tolist(), strict=True):
        for letters in _CONTRACTIONS:
            if i + 1 + len(letters) <= limit and whole.startswith(letters, i + 1):
                begins[i + 1] = False
                begins[i + 1 + len(letters)] = True
                break
    return begins[:-1]


class Encoder:
    """Tokens of many texts at once. Each distinct word of the texts is encoded once; nothing is remembered."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def cuts(self, texts: list[str], buffer: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Whether a word begins at each byte, and the added tokens by where they stand."""
        begins, added = clean_cuts(buffer, edges), {}
        for text, at, end in zip(texts, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if _CLEAN(text) and not any(s in text for s in self.automaton.special):
                continue
            begins[at:end] = False
            for run in self.automaton.words(text):
                if isinstance(run, int):
                    begins[at] = True
                    added[at] = run
                    at += len(self.automaton.labels[run])
                else:
                    sizes = np.fromiter((len(w.encode()) for w in run), np.int64, len(run))
                    begins[at + np.cumsum(sizes) - sizes] = True
                    at += int(sizes.sum())
        return begins, added

    def __call__(self, texts: list[str], buffer: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens; where those of each text begin, and the last end.

        texts: the same texts as in the buffer, text i from edges[i] to edges[i + 1].
        """
        if not len(buffer):
            return np.zeros(0, np.int32), np.zeros(len(edges), np.int64)
        begins, added = self.cuts(texts, buffer, edges)
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(buffer)))
        hashes = word_hashes(buffer, starts, sizes)
        order = np.argsort(hashes)
        a, b = order[:-1], order[1:]
        alike = (hashes[a] == hashes[b]) & (sizes[a] == sizes[b])
        meet = np.flatnonzero(alike)
        alike[meet] = equal_words(buffer, starts[a[meet]], starts[b[meet]], sizes[a[meet]])
        new = np.append(True, ~alike)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]
        ids, counts = self.automaton.many(buffer, starts[one], sizes[one])
        if added:  # further words, of one token each
            at = np.searchsorted(starts, np.fromiter(added, np.int64, len(added)))
            number[at] = len(counts) + np.arange(len(at))
            ids = np.concatenate([ids, np.fromiter(added.values(), np.int32, len(added))])
            counts = np.concatenate([counts, np.ones(len(at), np.int64)])
        first = np.cumsum(counts) - counts
        n = counts[number]
        upto = np.append(0, np.cumsum(n))
        flat = ids[np.repeat(first[number] - upto[:-1], n) + np.arange(upto[-1])]
        return flat, upto[np.searchsorted(starts, edges)]


@lru_cache(maxsize=2)
def automaton_of(path: str) -> Automaton:
    return Automaton.from_file(path)


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (array of int): the tokens of every text.

    docs: doc_id, text; other columns are ignored. Null text is empty and has no tokens. Repeated rows and
    rows without a doc_id are encoded each. Whole texts of any length; an empty table gives no rows.
    """
    return _by_text(docs, tokenizer, "doc_id long, ids array<int>", lambda automaton, ids: (ids,), (pa.list_(pa.int32()),))


def decoded(tokens: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text of tokens: doc_id, ids. Null ids give a null text; ids outside the vocabulary are an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(automaton_of(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal tokens joined by commas), decoded_sha256 of every document.

    docs: doc_id, text; other columns are ignored. Null text is empty: no tokens, and the digests are
    those of nothing. Repeated rows and rows without a doc_id get a row each. Added tokens that stand in a
    text are encoded as such. An empty table gives no rows.

    The automaton is compiled once on the driver and broadcast; its size is bounded by the vocabulary
    (20 MB for 50,000 merges), whatever the corpus. Documents don't move between tasks; some 4 MB of text,
    or one document, are encoded at once.
    """

    def digests(automaton: Automaton, ids: list[int]) -> tuple[int, str, str]:
        text = automaton.decode(ids)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _by_text(docs, tokenizer, schema, digests, (pa.int64(), pa.string(), pa.string()))


def _by_text(docs: DataFrame, tokenizer: str, schema: str, values, types: tuple) -> DataFrame:
    """doc_id and values(automaton, tokens) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton_of(tokenizer))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        encode = Encoder(automaton)
        for batch in batches:
            for some in slices(batch, 1, 1 << 22):
                texts = [t or "" for t in some.column(1).to_pylist()]
                ids, edges = encode(texts, *buffer_of(some.column(1)))
                rows = [values(automaton, ids[a:b].tolist()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
