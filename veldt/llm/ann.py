"""Approximate nearest neighbours by collision-counting hashing.

Every block of vectors keeps, for each of m random projections, its ids sorted by projected value.
A query opens a window around its own value in each sorted array and widens all of them together,
by a factor, which is virtual rehashing: nothing is hashed again. A vector seen in more than
`share` * m windows has crossed the collision threshold and is verified, once, by its true distance.
A query stops when a vector as near as its k-th best so far would have crossed the threshold by now
but for `margin` standard deviations of the collision count.

Vectors are dealt to cells by the nearest of some pivots, and large cells to blocks. A query first
searches its own cell. Its k-th best there bounds the windows that it will ever open, and it visits
another cell only if these windows meet the cell's range in as many projections as the threshold
asks for: in any other cell no vector can cross it. Near-duplicate and clustered vectors are found
in few cells; vectors without any structure are in reach of most windows, wherever they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import checkpointed

PROJECTIONS = 64
SHARE = 0.586
MARGIN = 0.7
WIDEN = 1.7
BLOCK = 4096
QUERY_BLOCK = 4096
#: pivots are at most this many vectors, those of the least hash of their id, for all vectors of one length
MOST_PIVOTS = 1024
SEED = 7


def axes_of(size: int, m: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """The projections of vectors of a length, one a column; the same in every task."""
    return np.random.default_rng(seed).standard_normal((size, m))


def reach_of(share: float = SHARE, margin: float = MARGIN, m: int = PROJECTIONS) -> float:
    """Half-width of the windows, in distances, at which a vector at this distance crosses the threshold."""
    p = min(0.999, share + margin * math.sqrt(share * (1 - share) / m))
    return NormalDist().inv_cdf((1 + p) / 2)


class BlockIndex:
    """Sorted projections of one block of vectors of one dimension."""

    def __init__(self, vectors: np.ndarray, m: int = PROJECTIONS):
        self.vectors = vectors
        self.axes = axes_of(vectors.shape[1], m)
        projected = vectors @ self.axes
        order = np.argsort(projected, axis=0, kind="stable")
        values = np.take_along_axis(projected, order, 0)
        # one flat array for all projections, each shifted clear of the one before
        self.n, self.m = projected.shape
        self.shift = (np.arange(self.m) * (4 * float(np.abs(values).max(initial=0)) + 8)) if self.m else np.zeros(0)
        self.values = (values + self.shift).T.ravel()
        self.order = order.T.ravel()
        self.first = np.arange(self.m) * self.n

    def search(
        self, query: np.ndarray, k: int, skip: np.ndarray, ids: np.ndarray, share: float = SHARE, margin: float = MARGIN,
        widen: float = WIDEN, bound: float = math.inf,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found; `skip` marks vectors that don't count.

        With a bound, a distance within which k others are known already, windows open to it at once.
        """
        n, m = self.n, self.m
        centre = query @ self.axes
        threshold = math.ceil(share * m)
        reach = reach_of(share, margin, m)
        counts = np.zeros(n, np.int64)
        verified = skip.copy()
        places, distances = np.zeros(0, np.int64), np.zeros(0)
        edge = float(self.shift[1] / 2 if m > 1 else np.inf) - 1
        centre = np.clip(centre, -edge, edge) + self.shift
        low = high = np.clip(np.searchsorted(self.values, centre), self.first, self.first + n)
        half = max(bound * reach if bound < math.inf else float(np.linalg.norm(query)) / 4, 1e-9)
        while True:
            a = np.maximum(np.searchsorted(self.values, centre - half), self.first)
            b = np.minimum(np.searchsorted(self.values, centre + half, side="right"), self.first + n)
            a, b = np.minimum(a, low), np.maximum(b, high)
            met = [self.order[i:j] for i, j in zip(a.tolist(), low.tolist(), strict=True) if i < j]
            met += [self.order[i:j] for i, j in zip(high.tolist(), b.tolist(), strict=True) if i < j]
            if met:
                counts += np.bincount(np.concatenate(met), minlength=n)
            low, high = a, b
            new = np.flatnonzero((counts >= threshold) & ~verified)
            if len(new):
                verified[new] = True
                gap = self.vectors[new] - query
                places = np.concatenate([places, new])
                distances = np.concatenate([distances, np.sqrt((gap * gap).sum(1))])
                best = np.lexsort((ids[places], distances))[:k]
                places, distances = places[best], distances[best]
            limit = min(bound, distances[-1] if len(places) == k else math.inf)
            if limit * reach <= half or (high - low == n).all():
                return places, distances
            # never wider than what the k-th best so far asks for
            wider = half * widen
            half = min(wider, distances[-1] * reach) if len(places) == k else wider


def _usable(embedding: str) -> F.Column:
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)


def neighbours(
    vectors: DataFrame, k: int = 10, every: int = 100, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """The k nearest rows found for every row whose vec_id is divisible by `every`.

    vectors: vec_id, embedding (array of numbers); other columns are ignored. Returns query_id, rank
    (from 1), vec_id, score: the Euclidean distance of the original vectors in double precision.
    Nearest first, ties to the smaller vec_id. Null, empty and zero vectors, and those that hold a
    null or non-finite component or have no id, take no part, as queries or otherwise; vectors of another length
    than the query's are not candidates. Rows that share the query's vec_id are its own; if a
    query's vec_id repeats, its least vector is the query. Fewer candidates than k give fewer rows;
    an empty table gives none.

    Cells are as many as blocks of `block` vectors would be, up to MOST_PIVOTS, whose pivots and ranges
    are broadcast; a cell of more vectors is split by a hash of their ids, so no cell is hot, and each
    of its blocks is searched by blocks of queries: memory is bounded by the two block sizes. Vectors
    with their cells, and the queries' bounds, are written to the shared checkpoint folder.
    """
    good = vectors.where(_usable("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    celled = checkpointed(_celled(good, block))
    counts = celled.groupBy("cell").agg(F.count("*").alias("n")).collect()  # at most MOST_PIVOTS cells a length of vectors
    if not counts:
        return good.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    blocks = {r["cell"]: max(1, math.ceil(r["n"] / block)) for r in counts}
    of_cell = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair])
    data = celled.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(of_cell, F.col("cell"))).cast("int"))
    first = F.struct(F.col("embedding"), F.col("cell"))
    queries = celled.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(first).alias("q")).select("vec_id", "q.embedding", "q.cell")

    def searched(asked: DataFrame) -> DataFrame:
        """asked: vec_id, embedding, cell (to search), bound."""
        share = max(1, math.ceil(asked.count() / query_block / max(1, len(blocks))))
        wanted = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(of_cell, F.col("cell")) - 1)))
        wanted = wanted.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(share)).cast("int"))
        rows = data.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
        keys = ["cell", "part", "share"]
        return rows.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(_searcher(k), "query_id long, vec_id long, score double")

    own = checkpointed(searched(queries.withColumn("bound", F.lit(None).cast("double"))))
    best = own.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("s"))  # at most k a block of one cell
    bounds = best.select(F.col("query_id").alias("vec_id"), F.get("s", F.lit(k - 1)).alias("bound"))
    known = checkpointed(queries.join(bounds, "vec_id", "left"))
    found = own.unionByName(searched(checkpointed(_routed(known, _ranges(celled)))))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searcher(k: int):
    """Per block of a cell: the k nearest found for each of its queries."""

    def run(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        if len(rows) and len(wanted):
            ids = rows["vec_id"].to_numpy()
            index = BlockIndex(np.stack(rows["embedding"].to_list()))
            bounds = wanted["bound"].astype(float).fillna(math.inf)
            for query_id, query, bound in zip(wanted["vec_id"], wanted["embedding"], bounds, strict=True):
                places, distances = index.search(np.asarray(query, float), k, ids == query_id, ids, bound=bound)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[places], "score": distances}))
        return pd.concat(out)

    return run


def _pivots(good: DataFrame, block: int) -> DataFrame:
    """size, k, embedding: the vectors of the least hashes of their ids, of each length, as many as blocks, at most MOST_PIVOTS.

    Only vectors whose hash is under what some four times as many should have are moved, once for an id, and the
    very least of each length, so that what one task orders doesn't grow with the table.
    """
    hashed = good.select(F.size("embedding").alias("size"), F.xxhash64("vec_id").alias("h"), "vec_id", "embedding")
    row = F.struct("h", "vec_id", "embedding")
    lengths = hashed.groupBy("size").agg(F.count("*").alias("n"), F.min(row).alias("least"))
    wanted = F.least(F.greatest(F.ceil(F.col("n") / block), F.lit(1)), F.lit(MOST_PIVOTS))
    below = hashed.join(F.broadcast(lengths.select("size", "n")), "size").withColumn("wanted", wanted)  # a row a length
    share = F.col("h") / 2.0**64 + 0.5
    few = below.where(share <= 4 * F.col("wanted") / F.col("n")).groupBy("size", "wanted", "h", "vec_id").agg(F.min("embedding").alias("embedding"))
    first = lengths.select("size", wanted.alias("wanted"), "least.*")
    every = few.unionByName(first).dropDuplicates(["size", "h", "vec_id", "embedding"])
    k = F.row_number().over(Window.partitionBy("size").orderBy("h", "vec_id", "embedding"))
    return every.withColumn("k", k).where(F.col("k") <= F.col("wanted")).select("size", "k", "embedding")


def _celled(good: DataFrame, block: int) -> DataFrame:
    """good with its cell: the length of the vector and the nearest pivot of this length, in one number."""
    picked = _pivots(good, block).collect()
    pivots: dict[int, list] = {}
    for r in sorted(picked, key=lambda r: (r["size"], r["k"])):
        pivots.setdefault(r["size"], []).append(r["embedding"])
    shared = good.sparkSession.sparkContext.broadcast({n: np.array(v) for n, v in pivots.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            lengths_ = batch["embedding"].str.len().to_numpy()
            for n in np.unique(lengths_):
                at = np.flatnonzero(lengths_ == n)
                own, near = np.stack(batch["embedding"].iloc[at].to_list()), shared.value[int(n)]
                gaps = (near * near).sum(1)[None, :] - 2 * own @ near.T
                cell[at] = (int(n) << 20) + np.argmin(gaps, 1)
            yield batch.assign(cell=cell)

    return good.mapInPandas(run, "vec_id long, embedding array<double>, cell long")


def _ranges(celled: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each cell in each projection; at most MOST_PIVOTS cells a length."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for cell, some in batch.groupby("cell"):
                own = np.stack(some["embedding"].to_list())
                projected = own @ axes_of(own.shape[1])
                rows.append((cell, projected.min(0).tolist(), projected.max(0).tolist()))
            yield pd.DataFrame(rows, columns=["cell", "low", "high"])

    parts = celled.mapInPandas(partial, "cell long, low array<double>, high array<double>")
    each = parts.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r")).groupBy("cell", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
    whole = each.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("r"))
    return {r["cell"]: (np.array([x["low"] for x in r["r"]]), np.array([x["high"] for x in r["r"]])) for r in whole.collect()}


def _routed(queries: DataFrame, ranges: dict[int, tuple[np.ndarray, np.ndarray]], share: float = SHARE) -> DataFrame:
    """A row for each query and other cell that holds vectors of its length and may hold one within its bound."""
    shared = queries.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.array(sorted(shared.value), np.int64)
        low, high = (np.stack([shared.value[c][i] for c in cells]) for i in (0, 1))
        least, reach = math.ceil(share * low.shape[1]), reach_of(share)
        for batch in batches:
            rows = []
            for vec_id, query, cell, bound in batch[["vec_id", "embedding", "cell", "bound"]].itertuples(index=False):
                centre = np.asarray(query, float) @ axes_of(len(query))
                half = math.inf if bound is None or bound != bound else max(bound * reach, 1e-9)
                met = ((low <= centre + half) & (high >= centre - half)).sum(1) >= least
                for other in cells[met & (cells != cell) & (cells >> 20 == cell >> 20)].tolist():
                    rows.append((vec_id, query, other, bound))
            yield pd.DataFrame(rows, columns=["vec_id", "embedding", "cell", "bound"])

    return queries.select("vec_id", "embedding", "cell", "bound").mapInPandas(run, "vec_id long, embedding array<double>, cell long, bound double")
