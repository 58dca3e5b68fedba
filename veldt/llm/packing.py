"""Best-fit packing of tokenised documents into fixed-length sequences, by bin completion.

Only lengths matter to a packing, and a length is at most the capacity. So the search runs on the
histogram of lengths (at most `capacity` numbers, whatever the corpus). Best-fit decreasing gives the
first incumbent. A node of the search takes the largest length left and branches over the undominated
fillings of the rest of its sequence, least waste first; it is pruned where the sequences used and a
bound from the waste on those still needed reach the incumbent. Equal sequences are taken many at a
time. Pieces are then dealt to the slots of their length by their rank, without moving any text.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.bytesio import joined, mixed
from veldt.llm.common import checkpointed, running_totals

CAPACITY = 4096
END_ID = 1
#: Nodes that the search over sequences, and each search for fillings, may visit by default.
NODES = 2000
#: fillings of a sequence that a search with a number of nodes branches over
WIDTH = 8


class _Histogram:
    """Counts of lengths, and the largest length up to each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.counts = [0] * (capacity + 1)
        for length, n in counts.items():
            self.counts[length] = n
        self.largest = [0] * (capacity + 1)
        self._refresh(1, capacity)

    def _refresh(self, low: int, high: int) -> None:
        last = self.largest[low - 1]
        for i in range(low, high + 1):
            if self.counts[i]:
                last = i
            self.largest[i] = last

    def add(self, length: int, n: int) -> None:
        had = self.counts[length] > 0
        self.counts[length] += n
        if had != (self.counts[length] > 0):
            above = length  # up to the next length that is there
            while above < self.capacity and not self.counts[above + 1]:
                above += 1
            self._refresh(length, above)

    def take(self, lengths: list[int], times: int) -> None:
        for x in lengths:
            self.add(x, -times)

    def times(self, lengths: list[int]) -> int:
        return min(self.counts[x] // lengths.count(x) for x in set(lengths))


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing, as (times, lengths descending): each piece goes where least room is left.

    Sequences that look alike are one entry, so the work grows with the distinct lengths only.
    """
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by room left
    rooms: list[int] = []

    def put(times: int, lengths: list[int], room: int) -> None:
        if times:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((times, lengths))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                times, lengths = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
            else:  # new sequences
                room, times, lengths = capacity, left, []
            each = room // length
            full = min(times, left // each)
            rest = left - full * each if full < times else 0  # fewer than `each`: one more sequence
            put(full, lengths + [length] * each, room - each * length)
            put(1 if rest else 0, lengths + [length] * rest, room - rest * length)
            if lengths:
                put(times - full - (1 if rest else 0), lengths, room)
            left -= full * each + rest
    return [x for group in open_.values() for x in group]


def undominated(lengths: list[int], room: int, counts: list[int], largest: list[int]) -> bool:
    """Whether no length that is left over can replace some of these, of at most its size, and still fit.

    A filling that has such a replacement is never better than the one with it. Only fillings of up
    to ten lengths are tested; not to test is safe.
    """
    if len(lengths) > 10:
        return True
    waste = room - sum(lengths)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    for s in sums:
        other = largest[min(room, s + waste)]
        while other and other >= max(s, 1):  # of the size of what it replaces, or more
            used = lengths.count(other)
            if counts[other] > used and (other > s or (s != other or not used)):
                return False
            other = largest[other - 1]
    return True


def fillings(counts: list[int], largest: list[int], room: int, nodes: int | None = NODES, most: int | None = WIDTH) -> list[list[int]]:
    """Undominated fillings of `room`, least waste first; at most counts[length] of each length.

    largest[r] is the largest length <= r that is left (0: none). Lengths are tried in descending
    order, as many as fit first, so the first descent is best fit. With `nodes` the search stops
    after that many steps, with `most` only so many fillings are kept, and branches that can't waste
    less than all of these are cut; without either all undominated fillings are returned. If the
    search stops before it has seen an undominated one, the one of least waste is returned.
    """
    found: list[tuple[int, list[int]]] = []
    seen_best: tuple[int, list[int]] = (room + 1, [])
    seen = 0
    path: list[tuple[int, int]] = []

    def limit() -> int:
        return found[-1][0] if most is not None and len(found) >= most else room + 1

    def reaches(length: int, left: int) -> bool:
        """Whether all lengths up to this one can bring the waste under the limit."""
        total, needed = 0, left - limit()
        while length and total <= needed:
            total += counts[length] * length
            length = largest[length - 1]
        return total > needed

    def search(left: int, upto: int) -> None:
        nonlocal seen, seen_best
        seen += 1
        if left < limit():
            lengths = [x for x, n in path for _ in range(n)]
            if left < seen_best[0]:
                seen_best = left, lengths
            if undominated(lengths, room, counts, largest):
                bisect.insort(found, (left, lengths), key=lambda f: f[0])
                if most is not None:
                    del found[most:]
        length = largest[min(left, upto)]
        while length and limit() and (nodes is None or seen < nodes) and reaches(length, left):
            for n in range(min(counts[length], left // length), 0, -1):
                path.append((length, n))
                search(left - n * length, length - 1)
                path.pop()
                if not limit() or (nodes is not None and seen >= nodes):
                    return
            length = largest[length - 1]

    search(room, room)
    return [lengths for _, lengths in found] or [seen_best[1]]


def patterns(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> list[tuple[int, list[int]]]:
    """(times, lengths descending) of sequences that use up the histogram.

    Never more sequences than best-fit decreasing; with nodes=None, as few as there can be. With a
    number of nodes, the search first descends by least waste, as far as that can beat the incumbent,
    and then branches over other fillings until so many nodes are spent or the bound is met: all
    tokens over the capacity, or the lengths over half of it.
    """
    best = best_fit(histogram, capacity)
    used_best = sum(t for t, _ in best)
    left = _Histogram({x: n for x, n in histogram.items() if n}, capacity)
    tokens = sum(x * n for x, n in histogram.items())
    least = max(-(-tokens // capacity), sum(n for x, n in histogram.items() if 2 * x > capacity))
    spent = 0
    path: list[tuple[int, list[int]]] = []

    def exhausted() -> bool:
        return used_best <= least or (nodes is not None and spent >= nodes)

    def choices(top: int, most: int | None):
        left.add(top, -1)
        room = capacity - top
        out = fillings(left.counts, left.largest, room, nodes, most) if room else [[]]
        left.add(top, 1)
        return out

    def branches(top: int):
        """The least-waste filling first; the others only if the search comes back here."""
        first = choices(top, 1)[0] if nodes is not None else None
        if first is not None:
            yield first
        yield from (f for f in choices(top, None if nodes is None else WIDTH) if f != first)

    def steps(used: int, tokens_left: int):
        """(times, lengths) to try at a node, as long as they can beat the incumbent."""
        nonlocal spent
        spent += backtracked
        top = left.largest[capacity]
        for filling in branches(top):
            lengths = [top, *filling]
            for times in range(left.times(lengths), 0, -1):
                after = tokens_left - times * sum(lengths)
                if used + times + -(-after // capacity) < used_best:
                    yield times, lengths, after

    # depth first, with the generators of the open nodes as the stack: a path may be very long
    stack = [steps(0, tokens)] if tokens else []
    used, backtracked = 0, False
    while stack and not exhausted():
        step = next(stack[-1], None)
        if step is None:
            backtracked = True
            stack.pop()
            if path:
                times, lengths = path.pop()
                used -= times
                left.take(lengths, -times)
            continue
        times, lengths, after = step
        left.take(lengths, times)
        used += times
        path.append((times, lengths))
        if after == 0:
            best, used_best, backtracked = path.copy(), used, True
            path.pop()
            used -= times
            left.take(lengths, -times)
        else:
            stack.append(steps(used, after))
    return best


def slots(found: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, slots of this length in a sequence, first offset).

    The pieces of a length, in rank order, fill the sequences of its first pattern, `slots` to each,
    one behind the other from `first offset`, then those of the next.
    """
    out, taken, sequence = [], {}, 0
    for times, lengths in found:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            n = lengths.count(length)
            first = taken.get(length, 0)
            out.append((length, first, sequence, n, offset))
            taken[length] = first + times * n
            offset += n * length
        sequence += times
    return out


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, place: str | None = None) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32, and its place if a column is named.

    White space separates words in this kind of vocabulary (it is dropped before anything is merged),
    so documents are put together from the ids of their words and marks. What a task keeps of them
    is bounded and ends with the task.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", place long" if place else "")
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()) + ((pa.int64(),) if place else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for some in _portions(batch):
                texts = [t or "" for t in some.column(1).to_pylist()]
                more = [(x,) for x in some.column(2).to_pylist()] if place else [()] * len(texts)
                for doc_id, tokens, own in zip(some.column(0).to_pylist(), encode(texts), more, strict=True):
                    data = tokens + end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *own))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text", *([F.col(place).cast("long")] if place else [])).mapInArrow(run, schema)


def _portions(batch: pa.RecordBatch, bound: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `bound` bytes of text each, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + bound, side="right")))
        yield batch.slice(at, end - at)
        at = end


#: Characters of a clean text: on these, lower-casing A-Z and the Latin capitals, and setting apart
#: contractions, single digits and runs of marks, cuts a text as the vocabulary's own rules do.
_CLEAN = re.compile(r"[\t-\r\x20-~\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff\u2010-\u2027\u20ac]*").fullmatch
_CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_BLANK, _LETTER, _DIGIT, _MARK = range(4)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0x30:0x3A] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: bytes of a piece that make up its key; longer pieces are told apart by themselves
_KEY = 24
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of clean texts: one lower-cased buffer, each piece's start and end in it, pieces of each text."""
    buffer, first, _ = joined(texts)
    kind, buffer = _CLASS[buffer], _LOWER[buffer]
    for lead, size in ((0xC2, 2), (0xC3, 2), (0xE2, 3)):
        at = np.flatnonzero(buffer == lead)
        if not len(at):
            continue
        after = buffer[at + 1]
        if lead == 0xC3:
            capital = at[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)]
            buffer[capital + 1] += 0x20
            at = at[(after == 0x97) | (after == 0xB7)]  # the times and division signs
        for i in range(size):
            kind[at + i] = _MARK
        if lead == 0xC2:
            wide = at[after == 0xA0]
            kind[wide] = kind[wide + 1] = _BLANK
    begins = np.ones(len(buffer) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    whole = buffer.tobytes()
    for i in np.flatnonzero((buffer == 0x27) & begins[:-1]).tolist():
        for letters in _CONTRACTIONS:
            if whole.startswith(letters, i + 1):
                begins[i + 1] = False
                begins[i + 1 + len(letters)] = True
                break
    full = kind != _BLANK
    starts = np.flatnonzero(begins[:-1] & full)
    ends = np.flatnonzero(begins[1:] & full) + 1
    edges = np.searchsorted(starts, np.append(first, len(buffer)))
    return whole, starts, ends, np.diff(edges)


@functools.lru_cache(maxsize=1)
def _tokenizers(path: str):
    """The tokenizer, and one of the same model that only cuts at blanks; kept as long as the worker."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    bare = Tokenizer(whole.model)
    bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ending = np.zeros(whole.get_vocab_size() + 1, bool)
    ending[[i for w, i in whole.get_vocab().items() if w.endswith("</w>")]] = True
    return whole, bare, ending


class _Known:
    """Pieces and their ids, in arrays sorted by a hash of the key; keys are compared in full."""

    def __init__(self, key: np.ndarray, ids: np.ndarray, count: np.ndarray):
        self.hash = _hashed(key)
        self.key, self.ids, self.count = key, ids, count
        self.first = np.cumsum(count) - count
        self.order = np.argsort(self.hash)
        self.hash = self.hash[self.order]

    def find(self, key: np.ndarray, hash_: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it is not here."""
        if not len(self.hash):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.hash, hash_), len(self.hash) - 1)
        place = self.order[at]
        return np.where((self.key[place] == key).all(1), place, -1)


def _hashed(key: np.ndarray) -> np.ndarray:
    out = mixed(key[:, 0])
    for i in range(1, key.shape[1]):
        out = mixed(out + key[:, i])
    return out


def _empty() -> _Known:
    return _Known(np.zeros((0, _KEY // 8), np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


class Encoder:
    """Texts to the bytes of their ids, little-endian unsigned 32-bit; no special tokens.

    Clean texts are cut into pieces here, and each distinct piece of some texts is looked up among
    known ones or encoded, many to a call, told apart by the ids that end a piece. Any other text is
    encoded whole by the tokenizer. At most `most` pieces are known, some 45 bytes each, and forgotten
    with the task that uses the encoder.
    """

    def __init__(self, path: str, most: int = 400_000, together: int = 1000):
        self.whole, self.bare, self.ending = _tokenizers(path)
        self.most, self.together = most, together
        self.known, self.recent = _empty(), _empty()

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, in order, and the number of each piece's."""
        ids, counts = [], []
        for i in range(0, len(pieces), self.together):
            part = pieces[i : i + self.together]
            own = np.array(self.bare.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ending[own]) + 1
            if len(ends) == len(part):
                counts.append(np.diff(ends, prepend=0))
            else:
                got = [e.ids for e in self.bare.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
                own = np.array([x for e in got for x in e], np.uint32)
                counts.append(np.array([len(e) for e in got], np.int64))
            ids.append(own)
        return np.concatenate(ids), np.concatenate(counts)

    def _clean(self, texts: list[bytes]) -> list[bytes]:
        whole, starts, ends, pieces = cut(texts)
        if not len(starts):
            return [b""] * len(texts)
        sizes = ends - starts
        padded = np.frombuffer(whole + bytes(_KEY), np.uint8)
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        key = np.stack([words[starts + 8 * i] & _MASK[np.clip(sizes - 8 * i, 0, 8)] for i in range(_KEY // 8)], 1)
        hash_ = _hashed(key)
        long = np.flatnonzero(sizes > _KEY)
        numbers: dict[bytes, int] = {}
        for i in long.tolist():  # too long for a key: a number stands for it, in this call only
            key[i] = 0, 0, numbers.setdefault(whole[starts[i] : ends[i]], len(numbers))
        hash_[long] = _hashed(key[long]) if len(long) else 0
        order = np.argsort(hash_)
        new = np.ones(len(order), bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]).any(1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]  # a piece of each kind
        lasting = sizes[one] <= _KEY
        at = np.where(lasting, self.known.find(key[one], hash_[one]), -1)
        near = np.where(lasting & (at < 0), self.recent.find(key[one], hash_[one]), -1)
        missing = np.flatnonzero((at < 0) & (near < 0))
        got = self._encoded([whole[a:b] for a, b in zip(starts[one[missing]].tolist(), ends[one[missing]].tolist(), strict=True)]) if len(missing) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        # ids of all kinds: those known, those known of late, those encoded now
        first, count = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        base = 0
        for ids, lengths, begin, here, place in (
            (self.known.ids, self.known.count, self.known.first, at >= 0, at),
            (self.recent.ids, self.recent.count, self.recent.first, near >= 0, near),
        ):
            first[here], count[here] = begin[place[here]] + base, lengths[place[here]]
            base += len(ids)
        first[missing], count[missing] = np.cumsum(got[1]) - got[1] + base, got[1]
        every = np.concatenate([self.known.ids, self.recent.ids, got[0]])
        n = count[number]
        upto = np.cumsum(n)
        flat = every[np.repeat(first[number] - (upto - n), n) + np.arange(int(upto[-1]))].astype("<u4").tobytes()
        self._learn(key[one], lasting, missing, *got)
        last = np.cumsum(pieces)
        cuts = np.append(0, upto)[np.append(0, last)] * 4
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _learn(self, key: np.ndarray, lasting: np.ndarray, missing: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        stays = lasting[missing]
        ids, count, key = ids[np.repeat(stays, count)], count[stays], key[missing[stays]]

        def merged(a: _Known, key: np.ndarray, ids: np.ndarray, count: np.ndarray) -> _Known:
            return _Known(np.concatenate([a.key, key]), np.concatenate([a.ids, ids]), np.concatenate([a.count, count]))

        self.recent = merged(self.recent, key, ids, count)
        if len(self.recent.key) > max(50_000, len(self.known.key) // 4):
            full = len(self.known.key) + len(self.recent.key) > self.most
            self.known = self.recent if full else merged(self.known, self.recent.key, self.recent.ids, self.recent.count)
            self.recent = _empty()

    def __call__(self, texts: list[str]) -> list[bytes]:
        clean = [bool(_CLEAN(t)) and "<|" not in t for t in texts]
        own = iter(self._clean([t.encode() for t, c in zip(texts, clean, strict=True) if c]))
        return [
            next(own) if c else np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, c in zip(texts, clean, strict=True)
        ]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int | None = NODES, place: str | None = None) -> DataFrame:
    """Pack all documents into as few sequences of at most `capacity` tokens as the search finds.

    With `place`, a column of numbers from 0 on in training order, equal lengths are dealt in this order, and
    sequences are numbered by the mean place of their pieces; place is then a column of the result.

    docs: doc_id, text; other columns are ignored. A document is its ids and one end id; only longer
    ones are cut, into pieces of `capacity`. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Null texts count as empty: one piece, the end id. Repeated rows are packed
    each; equal lengths are interchangeable and dealt in the order of a hash of their ids; an empty
    table gives no rows. The pieces' lengths, not texts, are written to the shared checkpoint folder
    so that no text is tokenised twice. The table of slots is broadcast: it has at most one row for
    each pattern and distinct length in it, and distinct lengths of a sequence add up to at most
    `capacity`, so they are under sqrt(2 * capacity) each, and each pattern uses up, or at least
    halves, a count of the histogram.
    """
    pieces = checkpointed(tokenized(docs, tokenizer, capacity, end_id, place))
    spark = docs.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = np.array(sorted(slots(patterns(histogram, capacity, nodes))), np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(found)
    places = (pieces.agg(F.max("place")).first()[0] or 0) + 1 if place else 1
    own = ["place"] if place else []
    ranked = running_totals(
        pieces.withColumn("_one", F.lit(1)), ["length"], "_one", ["doc_id", "piece", "ids_crc32"], sum(histogram.values()), "_rank", place=place and "place", places=places
    ).select("doc_id", "piece", "start", "length", "ids_crc32", *own, "_rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("place long, " if place else "") + "sequence_id long, offset long"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, sequence, per, offset = table.value.T
        keys = (lengths << 48) + first
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            nth = rank - first[at]
            columns = [*batch.columns[:-1], pa.array(sequence[at] + nth // per[at]), pa.array(offset[at] + nth % per[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    dealt = ranked.mapInArrow(deal, schema)
    return _in_order(checkpointed(dealt), places) if place else dealt


def _in_order(dealt: DataFrame, places: int) -> DataFrame:
    """Sequences numbered by the mean place of their pieces."""
    means = dealt.groupBy("sequence_id").agg(F.avg("place").alias("mean"), F.lit(1).alias("_one"))
    new = running_totals(means, [], "_one", ["sequence_id"], means.count(), "_new", place="mean", places=places).select("sequence_id", "_new")
    named = dealt.join(new, "sequence_id").drop("sequence_id").withColumnRenamed("_new", "sequence_id")
    return named.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "place")


def in_file_order(docs: DataFrame) -> DataFrame | None:
    """Rows of Parquet files written in order, with their place from 0 on; None if docs are not a plain scan of files.

    Files are in the order of the tasks that wrote them, which their names tell. Where each file begins
    is a row a task of that write, and joined by broadcast.
    """
    try:
        named = docs.select(*docs.columns, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return None
    at = named.withColumn("_file", F.coalesce(F.col("_file").try_cast("long"), F.lit(0)))
    counts = sorted((r["_file"], r["n"]) for r in at.groupBy("_file").agg((F.max("_row") + 1).alias("n")).collect())
    begins = np.cumsum([0, *(n for _, n in counts)]).tolist()
    table = docs.sparkSession.createDataFrame([(f, b) for (f, _), b in zip(counts, begins, strict=False)], "_file long, _begins long")
    return at.join(F.broadcast(table), "_file").withColumn("place", F.col("_begins") + F.col("_row")).select(*docs.columns, "place")
