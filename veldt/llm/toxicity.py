"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Tokens are words. Training tokens are labelled from document labels: a token of a toxic document
is toxic if a form of it (the word, or one of its prefixes) is far more frequent in toxic than in
other training documents. The chain has two labels; a token's emission is a sum of weights of its
forms. Forward-backward marginals give toxic offsets, and a logistic layer on their aggregates gives
the score of a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6, 7)
#: Bound of the training sample: toxic documents, and twice as many others.
SAMPLE = 700
SEGMENT = 128


def lowered(text: str) -> str:
    """The text in lower case, with a character for each of its own, so that offsets agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def forms(word: str) -> list[str]:
    """The word and its prefixes, the features of a token."""
    return [f"w={word}", *(f"{n}={word[:n]}" for n in PREFIXES if len(word) >= n)]


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    transition: np.ndarray  # 2 x 2 log potentials; a chain begins after a clean token
    layer: np.ndarray  # weights of aggregates(), constant last

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in forms(word))


def marginals(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """P(label = 1) of every token; chains begin at `starts` (ascending, first 0) and fill the array.

    Chains are cut into segments of SEGMENT tokens that advance together: transfer matrices of whole
    segments first, then messages over the segments of a chain, then messages inside all segments.
    """
    return _passes(emission, starts, transition)[0]


def _passes(emission: np.ndarray, starts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected number of each pair of neighbouring labels."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    lengths = np.diff(np.append(starts, n))
    per_chain = -(-lengths // SEGMENT)
    chain = np.repeat(np.arange(len(starts)), per_chain)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(per_chain) - per_chain, per_chain)
    seg_start = starts[chain] + nth * SEGMENT
    seg_len = np.minimum(SEGMENT, starts[chain] + lengths[chain] - seg_start)
    width = int(seg_len.max())
    place = seg_start[:, None] + np.arange(width)[None, :]
    real = np.arange(width)[None, :] < seg_len[:, None]
    e = np.where(real, emission[np.minimum(place, n - 1)], 0.0)
    e1 = np.exp(np.clip(e, -30, 30))  # potential of label 1; that of label 0 is 1
    t = np.exp(transition)
    s = len(chain)
    # transfer matrix of a segment: product over its tokens of T @ diag(1, e1)
    m = np.broadcast_to(np.eye(2), (s, 2, 2)).copy()
    for k in range(width):
        step = m @ t
        step[:, :, 1] *= e1[:, k, None]
        step /= step.max((1, 2), keepdims=True)
        m = np.where(real[:, k, None, None], step, m)
    ahead, behind = np.empty((s, 2)), np.empty((s, 2))
    first = np.flatnonzero(nth == 0)
    ahead[first] = (1.0, 0.0)
    for k in range(1, int(per_chain.max())):
        at = first[per_chain > k] + k
        x = np.einsum("ni,nij->nj", ahead[at - 1], m[at - 1])
        ahead[at] = x / np.abs(x).max(1, keepdims=True)
    last = first + per_chain - 1
    behind[last] = 1.0
    for k in range(1, int(per_chain.max())):
        at = last[per_chain > k] - k
        x = np.einsum("nij,nj->ni", m[at + 1], behind[at + 1])
        behind[at] = x / x.max(1, keepdims=True)
    alpha = np.empty((width, s, 2))
    a = ahead
    for k in range(width):
        x = a @ t
        x[:, 1] *= e1[:, k]
        x /= x.max(1, keepdims=True)
        a = np.where(real[:, k, None], x, a)
        alpha[k] = a
    p = np.zeros((s, width))
    pairs = np.zeros((2, 2))
    b = behind
    for k in range(width - 1, -1, -1):
        joint = alpha[k] * b
        total = joint.sum(1)
        p[:, k] = joint[:, 1] / total
        # pairs of this token and the one before it in its chain
        before = alpha[k - 1] if k else ahead
        has = real[:, k]
        out = b.copy()
        out[:, 1] *= e1[:, k]
        two = before[:, :, None] * t[None] * out[:, None, :]
        z = two.sum((1, 2))
        pairs += (two[has] / z[has, None, None]).sum(0)
        x = out @ t.T
        x /= x.max(1, keepdims=True)
        b = np.where(real[:, k, None], x, b)
    return p[real], pairs


def aggregates(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per chain: expected toxic tokens (log), the largest marginal, their share; constant 1."""
    n = len(starts)
    lengths = np.diff(np.append(starts, len(p)))
    full = lengths > 0
    out = np.zeros((n, 4))
    out[:, 3] = 1
    if full.any():
        at = starts[full]
        total = np.add.reduceat(p, at)
        out[full, 0] = np.log1p(total)
        out[full, 1] = np.maximum.reduceat(p, at)
        out[full, 2] = np.sqrt(total / lengths[full])
    return out


def _document_frequencies(docs: list[list[str]]) -> Counter:
    df: Counter = Counter()
    for words in docs:
        df.update({f for w in set(words) for f in forms(w)})
    return df


def token_labels(docs: list[list[str]], labels: list[int], least: float = 0.012, ratio: float = 20.0) -> set[str]:
    """Forms that mark a token of a toxic document as toxic.

    A form must occur in 3 and in a `least` share of the toxic documents, and be `ratio` times as
    frequent there as in other documents (add-half smoothed document rates).
    """
    toxic = _document_frequencies([d for d, y in zip(docs, labels, strict=True) if y])
    other = _document_frequencies([d for d, y in zip(docs, labels, strict=True) if not y])
    n1, n0 = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    return {f for f, n in toxic.items() if n >= max(3, least * n1) and (n / n1) / ((other[f] + 0.5) / n0) >= ratio}


def fit(texts: list[str], labels: list[int], rounds: int = 25, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Train the chain on the tokens of the texts, then the layer on the marginals it gives them.

    Emission weights and transitions are trained together by adaptive gradient ascent on the
    conditional likelihood: observed less expected counts, the latter from forward-backward.
    """
    docs = [TOKEN.findall(lowered(t)) for t in texts]
    marks = token_labels(docs, labels)
    types = sorted({w for d in docs for w in d})
    place = {w: i for i, w in enumerate(types)}
    df = _document_frequencies(docs)
    known = sorted(f for f, n in df.items() if n >= max(3, 0.004 * len(docs)))
    number = {f: i for i, f in enumerate(known)}
    rows, cols = [], []
    for i, w in enumerate(types):
        for f in forms(w):
            if f in number:
                rows.append(i)
                cols.append(number[f])
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    marked = np.array([any(f in marks for f in forms(w)) for w in types], bool)
    used = [(d, y) for d, y in zip(docs, labels, strict=True) if d]
    token = np.array([place[w] for d, _ in used for w in d], np.int64)
    lengths = np.array([len(d) for d, _ in used], np.int64)
    starts = np.cumsum(lengths) - lengths
    y = marked[token] & np.repeat(np.array([bool(v) for _, v in used]), lengths) if len(token) else np.zeros(0, bool)
    weights, bias = np.zeros(len(known)), -2.0
    transition = np.zeros((2, 2))
    if len(token):
        within = np.ones(len(token), bool)
        within[starts] = False
        at = np.flatnonzero(within)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
        np.add.at(seen, (0, y[starts].astype(int)), 1)
        observed = np.bincount(cols, np.bincount(token, y, len(types))[rows], len(known))
        g_w, g_b, g_t = np.full(len(known), 1e-2), 1e-2, np.full((2, 2), 1e-2)
        for _ in range(rounds):
            type_score = bias + np.bincount(rows, weights[cols], len(types))
            p, pairs = _passes(type_score[token], starts, transition)
            expected = np.bincount(cols, np.bincount(token, p, len(types))[rows], len(known))
            step = (observed - expected) - decay * weights
            g_w += step * step
            weights += rate * step / np.sqrt(g_w)
            step_b = y.sum() - p.sum()
            g_b += step_b * step_b
            bias += rate * step_b / math.sqrt(g_b)
            step_t = seen - pairs
            g_t += step_t * step_t
            transition = transition + 0.2 * rate * step_t / np.sqrt(g_t)
        type_score = bias + np.bincount(rows, weights[cols], len(types))
        p = marginals(type_score[token], starts, transition)
    else:
        p = np.zeros(0)
    x = aggregates(p, starts)
    target = np.array([float(v) for _, v in used])
    layer = np.zeros(4)
    layer[3] = -2.0
    for _ in range(2000 if len(target) else 0):
        q = 1 / (1 + np.exp(-x @ layer))
        layer += 2.0 * (x.T @ (target - q)) / len(target) - 1e-4 * layer
    keep = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) > 1e-6}
    return Model(keep, bias, transition, layer)


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> tuple[list[str], list[int]]:
    """At most `per_label` toxic and twice as many other texts, least by a hash of their id; texts are taken whole.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used. The sample's ids are at most
    9 * per_label rows, so that side is broadcast; only the sample's texts reach the driver.
    """
    usable = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    usable = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * per_label * (2 - y))
        ids = part if ids is None else ids.unionByName(part)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    picked = []
    for y in (0, 1):
        picked += rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_label * (2 - y)).collect()
    return [r["text"] for r in picked], [r["toxic"] for r in picked]


class _Scores(dict):
    """Emission of a word, computed once; emptied when it holds too many."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        if len(self) > self.most:
            self.clear()
        value = self[word] = self.model.emission(word)
        return value


def score(docs: DataFrame, model: Model, threshold: float = 0.5, span: float = 0.5) -> DataFrame:
    """Score of every document and the tokens that offend.

    docs: doc_id, text; other columns are ignored. Returns doc_id, score (0..1), predicted (1 if
    score >= threshold), n_toxic_tokens (expected), spans (array of start, end in code points of the
    text, marginal; for tokens whose marginal is at least `span`). Null, empty and
    wordless texts score what the layer gives to a document without toxic tokens; repeated rows get
    a row each; whole texts are scored, however long; an empty table gives no rows.
    """
    schema = (
        "doc_id long, score double, predicted int, n_toxic_tokens double, "
        "spans array<struct<start:long,end:long,marginal:double>>"
    )
    names = [x.split()[0] for x in schema.split(", ", 4)]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cache = _Scores(model)

        def flush(ids: list[int], texts: list[str]) -> pa.RecordBatch:
            emissions = [[cache[w] for w in TOKEN.findall(t)] for t in texts]
            lengths = np.array([len(e) for e in emissions], np.int64)
            flat = np.array([x for e in emissions for x in e], float)
            full = np.flatnonzero(lengths)
            starts = np.cumsum(lengths) - lengths
            p = marginals(flat, starts[full], model.transition)
            x = np.zeros((len(ids), 4))
            x[:, 3] = 1
            if len(full):
                x[full] = aggregates(p, starts[full])
            q = 1 / (1 + np.exp(-x @ model.layer))
            hits: dict[int, list] = defaultdict(list)
            for i in np.unique(np.searchsorted(starts[full], np.flatnonzero(p >= span), side="right") - 1):
                d = full[i]
                own = p[starts[d] : starts[d] + lengths[d]]
                for m, v in zip(TOKEN.finditer(texts[d]), own, strict=True):
                    if v >= span:
                        hits[d].append({"start": m.start(), "end": m.end(), "marginal": float(v)})
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(q), pa.array((q >= threshold).astype(np.int32)),
                    pa.array(np.expm1(x[:, 0])), pa.array([hits.get(i, []) for i in range(len(ids))], spans_type),
                ],
                names,
            )

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = lowered(t.as_py() or "")
                if ids and size + len(t) > 1 << 21:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
            if ids:
                yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """Fit on a bounded sample of labelled rows and score all documents.

    Documents that no label or no training fold covers are scored like any other. Without a single
    usable label the model knows no toxic form and gives every document the same low score.
    """
    model = fit(*training_sample(docs, labels, per_label))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = score(docs, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return out.select("doc_id", "held_out", "score", "predicted", "n_toxic_tokens", "spans")
