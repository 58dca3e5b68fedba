"""Filter interaction audit: what five document filters remove, alone, after each other, in every order.

One scan decides which filters each document fails, straight on the Arrow buffers: a table gives every
byte its classes, prefix sums of the classes count words, capitals and code points of a
document, and the sorted hashes of its words, verified by their bytes, count the distinct ones.
A document is then a mask of five bits. Every figure of every order is a sum over masks, so all
orders cost one aggregate over documents and a product of 32 x 600 numbers a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.arrow_text import buffer_of, equal_words, slices, word_hashes
from veldt.llm.bytesio import mixed
from veldt.llm.common import checkpointed

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SYMBOLS = b"#$%&*|"

_WHITE, _CAPITAL, _SYMBOL, _LEAD = 1, 2, 4, 8
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[0x20, *range(0x09, 0x0E)]] |= _WHITE
_CLASSES[0x41:0x5B] |= _CAPITAL
_CLASSES[list(SYMBOLS)] |= _SYMBOL
_CLASSES[[i for i in range(256) if i & 0xC0 != 0x80]] |= _LEAD
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _counts(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Set flags of each document, from prefix sums."""
    upto = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=upto[1:])
    return upto[edges[1:]] - upto[edges[:-1]]


def distinct_words(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, docs: int, hashes=word_hashes) -> np.ndarray:
    """Number of distinct words of each document.

    Words are sorted by document and hash. Neighbours of one hash are compared by their bytes; the documents
    where these differ, by a chance collision, are counted again by the words themselves.
    """
    if not len(starts):
        return np.zeros(docs, np.int64)
    key = mixed(hashes(buffer, starts, sizes) + mixed(owner.astype(np.uint64) + _STEP))
    order = np.argsort(key)
    a, b = order[:-1], order[1:]
    meet = np.flatnonzero(key[a] == key[b])
    a, b = a[meet], b[meet]
    alike = (owner[a] == owner[b]) & (sizes[a] == sizes[b])
    at = np.flatnonzero(alike)
    alike[at] = equal_words(buffer, starts[a[at]], starts[b[at]], sizes[a[at]])
    out = np.bincount(owner, minlength=docs) - np.bincount(owner[b[alike]], minlength=docs)
    for doc in np.unique(np.concatenate([owner[a[~alike]], owner[b[~alike]]])).tolist():
        own = np.flatnonzero(owner == doc)
        out[doc] = len({buffer[starts[i] : starts[i] + sizes[i]].tobytes() for i in own})
    return out


def failed(buffer: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Filters A to D that each document fails, as bits 0 to 3."""
    n = len(edges) - 1
    classes = _CLASSES[buffer]
    inside = (classes & _WHITE) == 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first, last = edges[:-1][edges[:-1] < edges[1:]], edges[1:][edges[:-1] < edges[1:]] - 1
    begins[first], ends[last] = inside[first], inside[last]  # words end with their document
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = _counts(begins, edges)
    owner = np.repeat(np.arange(n), words)
    distinct = distinct_words(buffer, starts, stops - starts, owner, n)
    capitals, points = _counts(classes & _CAPITAL != 0, edges), _counts(classes & _LEAD != 0, edges)
    symbols = _counts(classes & _SYMBOL != 0, edges)
    tests = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(t.astype(np.int64) << i for i, t in enumerate(tests))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, print (SHA-256 of the text), mask (filters A to D that it fails) of every document."""
    schema = "doc_id long, part string, print binary, mask int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 2):
                buffer, edges = buffer_of(some.column(2))
                view = memoryview(buffer)
                prints = [hashlib.sha256(view[a:b]).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                columns = [some.column(0), some.column(1), pa.array(prints, pa.binary()), pa.array(failed(buffer, edges), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text").mapInArrow(run, schema)


def _orders() -> tuple[list[str], list[int], dict[str, np.ndarray]]:
    """Order and step of each row of a part, and per figure a matrix of 32 masks x rows to sum documents by."""
    names, steps, earlier, own = [], [], [], []
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            names.append("".join(FILTERS[j] for j in order))
            steps.append(i + 1)
            earlier.append(sum(1 << j for j in order[:i]))
            own.append(1 << f)
    mask = np.arange(1 << len(FILTERS))[:, None]
    before, bit = np.array(earlier)[None, :], np.array(own)[None, :]
    fails, passed = (mask & bit) > 0, (mask & before) == 0
    total = len(names) // len(FILTERS)  # orders; a filter is first of the k that a document fails in one of k
    size = np.array([m.bit_count() for m in range(1 << len(FILTERS))])[:, None]
    figures = {
        "kept": passed & ~fails,
        "removed": passed & fails,
        "redundant": ~passed & fails,
        "unique_fails": np.broadcast_to(mask == bit, fails.shape),
        "shapley": fails * (total // np.maximum(size, 1)),
    }
    return names, steps, {k: v.astype(np.int64) for k, v in figures.items()}


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Kept, removed, redundant, unique and lost documents of each part, order of the filters and step.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns are ignored. Returns part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows
    a part. Null text is empty, null source the empty string. Rows without a doc_id come after
    all others: they fail E if any row with an id has their text, and carry no labels. Rows that
    repeat an id are documents each, and no duplicates of each other by that id alone. A document with
    several label rows is good, or toxic, if one of them says so; a document without labels is neither.
    A null label is not 1. An empty table gives no rows.

    Texts are read once and don't move. A row a distinct (text, id, part) is written to the shared checkpoint
    folder; a text that very many documents share is reduced to its least id before the shuffle, and the
    documents join that by text and id, so that no task gets all of its copies. What a part is reduced to
    is 32 counts.
    """
    keys = ["print", "doc_id", "part", "mask"]
    rows = checkpointed(scanned(docs).groupBy(*keys).agg(F.count("*").alias("n")))
    # the number is there to spread rows without an id
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("print")).otherwise(F.lit(0))
    first = rows.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    first = first.select(F.col("print").alias("first_print"), "first_id", F.lit(0).alias("repeats"))
    same = (F.col("print") == F.col("first_print")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    judged = rows.join(first, same, "left").select(
        "doc_id", spread.alias("spread"), "part", "n", (F.col("mask") + F.coalesce("repeats", F.lit(16))).alias("mask")
    )
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    labelled = judged.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    counts = labelled.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("good")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0)).alias("toxic")
    )
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32 a part
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, steps, by = _orders()
        for batch in batches:
            for part, found in zip(batch["part"], batch["counts"], strict=True):
                n, good, toxic = (np.zeros(1 << len(FILTERS), np.int64) for _ in range(3))
                for c in found:
                    n[c["mask"]], good[c["mask"]], toxic[c["mask"]] = c["n"], c["good"], c["toxic"]
                out = {k: n @ m for k, m in by.items()}
                out |= {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                yield pd.DataFrame({"part": part, "filter_order": names, "step": steps, **{k: out[k] for k in figures}})

    return parts.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in figures))


def filter_audit_sql() -> str:
    word = r"[^\x20\x09-\x0D]+"
    one = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[{SYMBOLS.decode()}]') THEN 8 ELSE 0 END
  + CASE WHEN min(doc_id) OVER (PARTITION BY text) < coalesce(doc_id, 9223372036854775807) THEN 16 ELSE 0 END AS mask FROM t),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {one} a(x), {one} b(x), {one} c(x), {one} d(x), {one} e(x)
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
q AS (SELECT *, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS earlier FROM s),
m AS (SELECT *, (mask & bit) > 0 AS fails, (mask & earlier) = 0 AS passed FROM c, q)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (passed AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (passed AND fails), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (NOT passed AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (passed AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (passed AND fails), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (fails), 0)::BIGINT AS shapley FROM m GROUP BY 1, 2, 3"""
