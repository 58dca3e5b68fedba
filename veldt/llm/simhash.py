"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit of a 64-bit fingerprint has a fixed nonzero code of radius + 1 bits. Table v, one for each
nonzero vector v of radius + 1 bits, keeps the bits whose code has an odd inner product with v. Two
fingerprints that differ in at most `radius` bits leave at least one v orthogonal to the codes of all
differing bits, and table v drops every one of these: the pair is certain to collide there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.bytesio import joint, mixed, windows, word_prints
from veldt.llm.common import checkpointed

SEED = 42
RADIUS = 4
SHINGLE = 4
#: buckets up to this size are compared pair by pair; larger ones are split first, exactly
BUCKET = 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def masks(radius: int = RADIUS) -> list[int]:
    """The 2**(radius + 1) - 1 covering masks of 64 bits, unsigned."""
    span = 2 ** (radius + 1)
    codes = [1 + i % (span - 1) for i in range(64)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, span)]


def text_fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """SimHash of each text: bit set if set in over half the hashes of its shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        plain = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = min(shingle, len(words)) - 1
        hashes += [digest(plain[a:b], seed) for a, b in zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)]
        sizes[i] = len(words) - last
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array(hashes, np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (np.cumsum(sizes) - sizes)[full]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        majority = (2 * ones > sizes[full, None]).astype(np.uint8)
        out[full] = np.packbits(majority, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(batch):
                part, size = [], 0
                while at + len(part) < len(batch) and (not part or size < 1 << 20):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1])
                fp = text_fingerprints(part, shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(fp)], ["doc_id", "fp"])
                at += len(part)

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, fp long")


def _find(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def linked(values: np.ndarray, radius: int = RADIUS, bucket: int = BUCKET) -> list[tuple[int, int]]:
    """Edges that connect what pairs within the radius connect; fewer than there are values."""
    parent: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        x, y = _find(parent, a), _find(parent, b)
        if x != y:
            parent[x] = y
            out.append((a, b))

    def compare(part: np.ndarray) -> None:
        if len(part) < 2:
            return
        varying = np.bitwise_or.reduce(part ^ part[0])
        free = [i for i in range(64) if int(varying) >> i & 1]
        if len(free) <= radius:  # all of them are within the radius of each other
            for b in part[1:].tolist():
                join(int(part[0]), b)
        elif len(part) <= bucket:
            for i in range(len(part) - 1):
                for j in np.flatnonzero(np.bitwise_count(part[i + 1 :] ^ part[i]) <= radius).tolist():
                    join(int(part[i]), int(part[i + 1 + j]))
        else:  # a pair within the radius agrees on one of radius + 1 groups of the varying bits
            for k in range(radius + 1):
                own = np.uint64(sum(1 << i for i in free[k :: radius + 1]))
                key = part & own
                order = np.argsort(key, kind="stable")
                for piece in np.split(part[order], np.flatnonzero(np.diff(key[order])) + 1):
                    compare(piece)

    compare(np.unique(values))
    return out


def reached(values: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Places (i, j) of rows that connect what pairs at up to `limit` differing bits connect.

    Rows are visited from one to the next, each compared only with those not yet visited: a family of
    near copies is done after one comparison with its first member.
    """
    left, out = np.arange(len(values)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = np.bitwise_count(values[left] ^ values[i]).sum(1) <= limit
            found = left[near].tolist()
            out += [(i, j) for j in found]
            todo += found
            left = left[~near]
    return out


def stars(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least of its component, node) for all nodes that the given pairs connect: fewer than there are nodes."""
    nodes, place = np.unique(pairs, return_inverse=True)
    a, b = place.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[root[own]], nodes[own]], 1)


def in_buckets(keyed: DataFrame, names: list[str], limit: int, link) -> DataFrame:
    """Edges (a, b) between nodes that share a bucket and differ in at most `limit` bits of columns `names`.

    keyed: no and key, which name a bucket; node; names. Buckets are sorted runs of their partition,
    read one after the other: no bucket is ever one row. `link` connects the members of a bucket of
    more than 32, given their values; smaller buckets are compared at once. What a task finds leaves
    it as stars around the least node of each component, so a family of copies that meets in many
    buckets costs a row for each of its members, not one for each meeting.
    """
    once = keyed.withColumn("_n", F.count("*").over(Window.partitionBy("no", "key"))).where("_n > 1")
    rows = once.select("no", "key", "node", *names)

    def pairs_of(parts: list[pa.RecordBatch]) -> np.ndarray:
        """Pairs that connect the members of each bucket; the parts hold whole buckets."""
        table = pa.Table.from_batches(parts)
        no, key, node = (table.column(c).to_numpy() for c in ("no", "key", "node"))
        values = np.stack([table.column(c).to_numpy().view(np.uint64) for c in names], 1)
        first = np.flatnonzero(np.append(True, (no[1:] != no[:-1]) | (key[1:] != key[:-1])))
        sizes = np.diff(np.append(first, len(no)))
        group = np.repeat(np.arange(len(first)), sizes)
        found: list[np.ndarray] = []
        for at, n in zip(first[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
            found.append(node[at + np.array(link(values[at : at + n]), np.int64).reshape(-1, 2)])
        small = np.flatnonzero(np.repeat(sizes <= 32, sizes))
        group, own, who = group[small], values[small], node[small]
        for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
            at = np.flatnonzero(group[d:] == group[:-d])
            at = at[np.bitwise_count(own[at + d] ^ own[at]).sum(1) <= limit]
            found.append(np.stack([who[at], who[at + d]], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket seen, as it may go on
        pairs: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            no, key = batch.column("no").to_numpy(), batch.column("key").to_numpy()
            cut = int(np.flatnonzero((no != no[-1]) | (key != key[-1]))[-1]) + 1 if (no[0], key[0]) != (no[-1], key[-1]) else 0
            if held and cut == 0 and _first(held[0]) == _first(batch):
                held.append(batch)
                continue
            ended = [*held, batch.slice(0, cut)] if cut else held
            if ended:
                pairs.append(pairs_of(ended))
            held = [batch.slice(cut)]
            if sum(map(len, pairs)) > 200_000:
                pairs = [stars(np.concatenate(pairs))]
        if held:
            pairs.append(pairs_of(held))
        out = stars(np.concatenate(pairs)) if pairs else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return rows.repartition("no", "key").sortWithinPartitions("no", "key").mapInArrow(run, "a long, b long").distinct()


def _first(batch: pa.RecordBatch) -> tuple[int, int]:
    return batch.column("no")[0].as_py(), batch.column("key")[0].as_py()


def _covering(column: str, radius: int, start: int = 0) -> list[F.Column]:
    """A struct (no, key) for each covering table of a fingerprint column."""
    signed = [m - 2**64 if m >= 2**63 else m for m in masks(radius)]
    return [F.struct(F.lit(start + i).alias("no"), F.col(column).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]


def _spread(nodes: DataFrame) -> DataFrame:
    """Over enough tasks for each row to become a row a table."""
    return nodes.repartition(max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.sparkSession.sparkContext.defaultParallelism))


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span the same components as all links.

    Only distinct fingerprints get here, so copies cost nothing. A large bucket of a table yields
    fewer edges than it has members.
    """
    keyed = _spread(nodes).select("fp", F.explode(F.array(*_covering("fp", radius))).alias("t"))
    keyed = keyed.select("t.no", "t.key", F.col("fp").alias("node"), "fp")

    def link(values: np.ndarray) -> list[tuple[int, int]]:
        own = values[:, 0]
        place = {v: i for i, v in enumerate(own.tolist())}
        return [(place[a], place[b]) for a, b in linked(own, radius, bucket)]

    return in_buckets(keyed, ["fp"], radius, link)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the least node of each component, by alternating large and small stars.

    Every round is written to the shared checkpoint folder. A star's centre is summed before it is
    joined back, so that a node with very many edges is no window of its own.
    """

    def least(pairs: DataFrame) -> DataFrame:
        """For each (u, v): the least of u and of all v of u."""
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return pairs.join(low, "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())

    edges = checkpointed(edges)
    before = mark(edges)
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = least(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
        large = large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        small = least(down).select(F.explode(F.array("u", "v")).alias("x"), "m").where("x != m")
        edges = checkpointed(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct())
        after = mark(edges)
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of every document.

    docs: doc_id, text; other columns are ignored. Returns doc_id, fingerprint (16 lowercase hex
    digits), component_id (least doc_id reachable over links), n_links (other distinct fingerprints
    aside, the documents of the same fingerprint). Null, empty and wordless texts have fingerprint
    zero and are linked like any other. Repeated rows get a row each; an empty table gives no rows.
    """
    marked = checkpointed(fingerprints(docs, shingle))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same"))
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(heads, "root").select("fp", "component_id", "n_same")
    return marked.join(known, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same"
    )


#: Near copies: bits of the signature that may differ. Shingle sets of Jaccard similarity 0.8 have
#: fingerprints that differ in 0.15 of their bits, 39 of 256, give or take 6.
SIGNATURE = 4
SIGNATURE_BITS = 46
#: independent fingerprints of the words, each with its covering tables
WORD_SEEDS = 4


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each group of consecutive hashes: bits set in over half of them; 0 for empty groups."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    pieces = -(-sizes[full] // 255)  # a byte can count so many
    owner_ = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner_)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.repeat((np.cumsum(sizes) - sizes)[full], pieces) + nth * 255
    first = np.cumsum(pieces) - pieces
    ones, ones_mask = np.zeros((len(full), 64), np.int64), np.uint64(0x0101010101010101)
    for bit in range(8):  # eight counters, of bits bit, bit + 8, .., in the bytes of one sum
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & ones_mask, at)
        ones[:, bit::8] = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    out[full] = np.packbits((2 * ones > sizes[full, None]).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()
    return out


def signatures(texts: list[bytes], shingle: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, word fingerprints and signature of each text.

    The node is a hash of the words in order, A-Z lower-cased. A word fingerprint is the SimHash of
    the distinct words, one for each of WORD_SEEDS; the signature is SIGNATURE SimHashes of the
    distinct shingles. A text of fewer words than a shingle is one shingle; a wordless one has zeros.
    """
    texts = [t.translate(_LOWER) for t in texts]
    node = np.array([xxhash.xxh3_64_intdigest(b" ".join(t.split())) for t in texts], np.uint64).view(np.int64)
    words, counts = word_prints(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)

    def distinct(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = joint(rows, values)
        at = np.sort(np.unique(key, return_index=True)[1])
        return values[at], np.bincount(rows[at].astype(np.int64), minlength=len(texts))

    own, sizes = distinct(words, row)
    by_word = np.stack([majority(mixed(own + np.uint64(1000 + i)), sizes) for i in range(WORD_SEEDS)], 1)
    runs = windows(words, shingle)
    inside = row[: len(runs)] == row[len(words) - len(runs) :]
    runs, rows = runs[inside], row[: len(runs)][inside]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    runs, rows = np.append(runs, node[short].view(np.uint64)), np.append(rows, short.astype(np.uint64))
    order = np.argsort(rows, kind="stable")
    own, sizes = distinct(runs[order], rows[order])
    by_shingle = np.stack([majority(mixed(own ^ mixed(np.uint64([i + 1]))), sizes) for i in range(SIGNATURE)], 1)
    return node, by_word.view(np.int64), by_shingle.view(np.int64)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest of the text, node, w0.. (word fingerprints), s0.. (signature)."""
    names = [*(f"w{i}" for i in range(WORD_SEEDS)), *(f"s{i}" for i in range(SIGNATURE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy().astype(np.int64))
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), side="right")))
                part = batch.slice(at, end - at)
                node, by_word, by_shingle = signatures(part.column("text").to_pylist(), shingle)
                columns = [part.column("doc_id"), part.column("digest"), pa.array(node)]
                columns += [pa.array(np.ascontiguousarray(c)) for c in (*by_word.T, *by_shingle.T)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "node", *names])
                at = end

    text = F.coalesce("text", F.lit(""))
    inner = docs.select("doc_id", F.md5(text.cast("binary")).alias("digest"), text.cast("binary").alias("text"))
    return inner.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, digest string, node long, " + ", ".join(f"{n} long" for n in names))


def near_copies(docs: DataFrame, shingle: int = 5, bits: int = SIGNATURE_BITS) -> DataFrame:
    """Component of every row: doc_id, digest (MD5 of the text), node, root.

    Rows whose words are the same in order are one node. Covering tables of the word fingerprints
    bring together what differs in few words: an edited word changes five shingles but one word, so
    these fingerprints are within their radius where those of the shingles are far from it. What
    meets is linked if its signatures, SimHashes of `shingle`-word shingles, differ in at most `bits`
    of 256 bits, that is at a Jaccard similarity of 0.8 or more but for the estimate's own scatter.
    """
    marked = checkpointed(_signed(docs, shingle))
    words, signature = [f"w{i}" for i in range(WORD_SEEDS)], [f"s{i}" for i in range(SIGNATURE)]
    nodes = marked.groupBy("node").agg(*[F.first(c).alias(c) for c in words + signature])
    nodes = checkpointed(nodes)
    tables = len(masks(RADIUS))
    keys = [t for i, w in enumerate(words) for t in _covering(w, RADIUS, i * tables)]
    keyed = _spread(nodes).select("node", F.explode(F.array(*keys)).alias("t")).select("t.no", "t.key", "node")
    met = keyed.withColumn("_n", F.count("*").over(Window.partitionBy("no", "key"))).where("_n > 1").drop("_n")
    edges = in_buckets(met.join(nodes.select("node", *signature), "node"), signature, bits, lambda values: reached(values, bits))
    roots = components(edges)
    rows = marked.select("doc_id", "digest", "node")
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def representatives(docs: DataFrame, shingle: int = 5, bits: int = SIGNATURE_BITS) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id; same columns as docs.

    Rows without an id come last and are documents like any other; rows that share an id are told
    apart by their texts, and of rows that agree in id and text one stays. Null and wordless texts
    are copies of each other. An empty table gives no rows.
    """
    inner = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"own_{c}") for c in docs.columns])
    found = near_copies(inner.select("doc_id", "text"), shingle, bits)
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")
    first = found.groupBy("root").agg(F.min(order).alias("_f")).select(
        F.coalesce(F.col("_f.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("_f.no").alias("_no"), F.col("_f.digest").alias("_digest")
    )
    keyed = inner.select(
        "*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("doc_id").isNull().alias("_no"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"),
    )
    kept = keyed.join(first, ["_id", "_no", "_digest"])
    same = Window.partitionBy("_id", "_no", "_digest").orderBy(F.lit(1))
    kept = kept.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"own_{c}").alias(c) for c in docs.columns])
