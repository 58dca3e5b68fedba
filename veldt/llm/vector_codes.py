"""Vector code compression: a codebook for each part of a vector, fitted in integers; codes by VA-file filtering.

Vectors are cut into equal parts; a part is coded by the nearest entry of its position's codebook. To
find it, the coordinates of the entries are quantised to a few bits, which lays them into cells. For
each query two lookup tables hold the least and the greatest squared gap to every cell of every
coordinate; added up by the entries' cells they bound every distance from below and from above. Only
entries whose lower bound does not exceed the least upper bound are refined, by integer distances.

A round of fitting is one pass over the vectors: every task adds up its own parts by entry, so what is
shuffled is a codebook a task, and what the driver holds is one codebook.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import checkpointed

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: bits of a quantised coordinate
BITS = 3
#: vectors whose lookup tables are held at once
CHUNK = 4096
#: labels with at least this share of all rows get their total by broadcast: there are at most 1/SHARE of them
SHARE = 0.001

#: per length of vectors, per part: entries x components
Codebooks = dict[int, list[np.ndarray]]


def bounds_of(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end; equal parts where `parts` divides its size."""
    return [p * size // parts for p in range(parts + 1)]


def most_of(size: int) -> int:
    """Greatest magnitude of a component in integers, so that no squared distance leaves 63 bits."""
    return math.isqrt(2**63 // max(size, 1)) // 2 - 1


class CellIndex:
    """The entries of one codebook, their coordinates in cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = np.asarray(entries, np.int64)
        n, width = self.entries.shape
        per = -(-n // (1 << bits))
        cells = -(-n // per)
        order = np.argsort(self.entries, axis=0, kind="stable")
        cell = np.empty((n, width), np.int64)
        np.put_along_axis(cell, order, np.broadcast_to((np.arange(n) // per)[:, None], (n, width)), 0)
        ranked = np.take_along_axis(self.entries, order, 0)
        begins = np.arange(cells) * per
        #: least and greatest coordinate in each cell: coordinate x cell
        self.low = ranked[begins].T.astype(float)
        self.high = ranked[np.minimum(begins + per, n) - 1].T.astype(float)
        # adds up the table entries of the cells that a codebook entry lies in
        self.sum = np.zeros((width, cells, n))
        self.sum[np.arange(width)[None, :], cell, np.arange(n)[:, None]] = 1.0
        self.sum = self.sum.reshape(width * cells, n)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x entries."""
        q = queries.astype(float)[:, :, None]
        below, above = self.low - q, q - self.high
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(-below, -above)
        n = len(queries)
        # exact under 2**53; beyond, the slack is wider than the rounding
        return (near * near).reshape(n, -1) @ self.sum * (1 - 1e-12), (far * far).reshape(n, -1) @ self.sum * (1 + 1e-12)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, ties to the lower index."""
        if not self.entries.shape[1]:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        found = [self._nearest(queries[i : i + CHUNK]) for i in range(0, len(queries), CHUNK)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.bounds(queries)
        row, entry = np.nonzero(low <= high.min(1)[:, None])
        gap = queries[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", gap, gap)
        begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        best = np.minimum.reduceat(distance, begins)
        at = np.flatnonzero(distance == best[row])
        first = at[np.r_[True, row[at][1:] != row[at][:-1]]]
        return entry[first], best


def scaled(column: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, components as integers, rows x size) of each length of vector in a column of lists.

    Rows that are null or hold a null or non-finite component are left out.
    """
    lists = pc.cast(column, pa.large_list(pa.float64()))
    lengths = np.diff(lists.offsets.to_numpy())
    null = lists.is_null().to_numpy(zero_copy_only=False)
    lengths = np.where(null, -1, lengths)
    begins = lists.offsets.to_numpy()[:-1]
    values = lists.values.to_numpy(zero_copy_only=False)  # nulls come as NaN
    for size in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        own = values[begins[rows][:, None] + np.arange(size)]
        good = np.isfinite(own).all(1)
        if not good.any():
            continue
        limit = most_of(size)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(own[good] * float(scale)), -limit, limit)
        yield rows[good], whole.astype(np.int64)


def _first_rows(good: DataFrame, entries: int, scale: int) -> DataFrame:
    """size, vec_id, whole (integers): the rows of the least vec_ids of each length, at most `entries` a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, list] = {}
        for batch in batches:
            ids, null = pc.fill_null(batch.column(0), 0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for rows, whole in scaled(batch.column(1), scale):
                order = np.lexsort([*whole.T[::-1], ids[rows], null[rows]])[:entries]
                own = [(bool(null[r]), int(ids[r]), whole[i].tolist()) for i, r in zip(order, rows[order], strict=True)]
                size = whole.shape[1]
                least[size] = sorted(least.get(size, []) + own)[:entries]
        rows_ = [(size, None if no else i, w) for size, few in least.items() for no, i, w in few]
        columns = list(zip(*rows_, strict=True)) or [(), (), ()]
        types = (pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["size", "vec_id", "whole"])

    return good.select("vec_id", "embedding").mapInArrow(run, "size int, vec_id long, whole array<long>")


def first_codebooks(good: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the rows of the least vec_ids, of each length of vectors."""
    order = Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "whole")
    few = _first_rows(good, entries, scale).withColumn("k", F.row_number().over(order)).where(F.col("k") <= entries)
    by_size: dict[int, list] = {}
    for r in sorted(few.collect(), key=lambda r: (r["size"], r["k"])):
        by_size.setdefault(r["size"], []).append(r["whole"])
    out = {}
    for size, rows in by_size.items():
        edges, whole = bounds_of(size, parts), np.array(rows, np.int64).reshape(len(rows), size)
        out[size] = [whole[:, a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def refitted(good: DataFrame, books: Codebooks, scale: int = SCALE, bits: int = BITS) -> Codebooks:
    """One round: assign all parts, replace each entry by the floor of its parts' mean; unused entries stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {size: [CellIndex(b, bits) for b in book] for size, book in books.items()}
        sums = {size: [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in book] for size, book in books.items()}
        for batch in batches:
            for _, whole in scaled(batch.column(0), scale):
                size = whole.shape[1]
                edges = bounds_of(size, len(index[size]))
                for p, cells in enumerate(index[size]):
                    own = whole[:, edges[p] : edges[p + 1]]
                    entry, _ = cells.nearest(own)
                    order = np.argsort(entry, kind="stable")
                    used, begins, counts = np.unique(entry[order], return_index=True, return_counts=True)
                    if len(used):
                        sums[size][p][used, 0] += counts
                        sums[size][p][used, 1:] += np.add.reduceat(own[order], begins, axis=0)
        rows = [(size, p, e, x.tolist()) for size, s in sums.items() for p, part in enumerate(s) for e, x in enumerate(part) if x[0]]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["size", "part", "entry", "sums"])

    partial = good.select("embedding").mapInArrow(run, "size int, part int, entry int, sums array<long>")
    each = partial.select("size", "part", "entry", F.posexplode("sums").alias("i", "x"))
    total = each.groupBy("size", "part", "entry", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found: dict[tuple, dict] = {}
    for r in total.collect():  # one codebook
        found.setdefault((r["size"], r["part"], r["entry"]), {})[r["i"]] = int(r["x"])
    out = {size: [b.copy() for b in book] for size, book in books.items()}
    for (size, part, entry), sums in found.items():
        width = out[size][part].shape[1]
        out[size][part][entry] = [sums[i + 1] // sums[0] for i in range(width)]
    return out


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for x in part.ravel().tolist()).encode()).hexdigest()


def coded(good: DataFrame, books: Codebooks, scale: int = SCALE, bits: int = BITS) -> DataFrame:
    """vec_id, label, size, code, error of every vector."""
    schema = "vec_id long, label string, size int, code string, error long"
    hexes = np.array([f"{i:02x}" for i in range(256)], "U2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {size: [CellIndex(b, bits) for b in book] for size, book in books.items()}
        for batch in batches:
            for rows, whole in scaled(batch.column(2), scale):
                size = whole.shape[1]
                edges = bounds_of(size, len(index[size]))
                code, error = np.zeros(len(rows), "U1"), np.zeros(len(rows), np.int64)
                for p, cells in enumerate(index[size]):
                    entry, distance = cells.nearest(whole[:, edges[p] : edges[p + 1]])
                    code, error = np.char.add(code, hexes[entry]), error + distance
                at = pa.array(rows)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(rows), size, np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code.tolist(), pa.string()), pa.array(error)], [x.split()[0] for x in schema.split(", ")])

    return good.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, bits: int = BITS
) -> DataFrame:
    """Code of every vector, its error, its label's error, and the codebooks' digest.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored. Returns vec_id,
    code (two hex digits a part), error, label_error (long), codebooks_sha256. Rows whose vector is
    null or holds a null or non-finite component are dropped; zero vectors stay, and so do rows without a
    vec_id, which come after all others. A component x counts as floor(scale * x); one so large
    that a squared distance could leave 63 bits counts as the largest that can't. The
    codebooks start as the rows of the least vec_ids; where one repeats, its rows follow by their
    vectors, equal rows each. With fewer rows than `entries` a codebook has as many entries as
    there are rows. Vectors of different lengths have codebooks of their own; lengths must be few, as
    all codebooks are held by the driver. Parts are equal where their number divides the length, and else
    as equal as can be. Null labels are one group. An empty table gives no rows.

    `entries` is at most 256. The fit uses all rows; its state is `parts` * `entries` sums. Codes and
    errors, not vectors, are written to the shared checkpoint folder. A label's total reaches its
    rows by a broadcast where the label holds a thousandth of all rows or more (at most 1000 labels do), else
    by a join on the label, which then has no hot key.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    books = first_codebooks(good, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = refitted(good, books, scale, bits)
    rows = checkpointed(coded(good, books, scale, bits))
    totals = checkpointed(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    n = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = totals.select(F.col("label").alias("own"), "label_error", (F.col("n") >= F.lit(n * SHARE)).alias("heavy"))
    heavy, light = own.where("heavy").drop("heavy"), own.where("NOT heavy").drop("heavy")
    same = F.col("label").eqNullSafe(F.col("own"))
    few = rows.join(F.broadcast(heavy), same)
    many = rows.join(F.broadcast(heavy), same, "left_anti").join(light, same)
    digests = F.create_map(*[F.lit(x) for size, book in books.items() for x in (size, digest(book))]) if books else F.lit(None).cast("map<int,string>")
    return few.unionByName(many).select("vec_id", "code", "error", "label_error", F.element_at(digests, F.col("size")).alias("codebooks_sha256"))


def vector_codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """For tables whose vectors are of one length, which `parts` divides, and whose vec_ids are distinct."""
    ctes = [
        f"""WITH g AS (SELECT vec_id, label, embedding, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT vec_id, width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM g),
v AS (SELECT vec_id, i // width AS part, i % width AS pos, CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM g ORDER BY vec_id LIMIT {entries}),
b0 AS (SELECT part, entry, pos, x FROM v JOIN f USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        ctes.append(
            f"""d{r} AS (SELECT vec_id, v.part, entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN b{r} b ON v.part = b.part AND v.pos = b.pos GROUP BY 1, 2, 3),
a{r} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""
        )
        if r < rounds:
            ctes.append(
                f"""m{r} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} USING (vec_id, part) GROUP BY 1, 2, 3),
b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN x ELSE s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END END AS x FROM b{r} LEFT JOIN m{r} USING (part, entry, pos))"""
            )
    ctes.append(
        f"""c AS (SELECT vec_id, lower(string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part)) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})"""
    )
    return ",\n".join(ctes) + (
        "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN g USING (vec_id), h"
    )
