import math

import numpy as np

from veldt.llm.ann import _celled, _ranges, _routed, neighbours


def brute(rows, k=10, every=100):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q))
            out[i] = near[:k]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((3000, 32)).astype(np.float32)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    got = {}
    for r in neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda x: (x[2], x[1]))
        for _, j, s in found:
            assert abs(s - math.dist(points[q].astype(float), points[j].astype(float))) < 1e-9


def test_copies_odd_vectors_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0, 2.0, 3.0])]
    rows += [(i, [1.0, 0.0]) for i in range(8, 40)] + [(100, [float("inf"), 0.0]), (200, [2.0, 0.0]), (None, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS block")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours(df).collect())
    assert [(q, v, s) for q, _, v, s in got if q == 0] == [(0, v, 0.0) for v in (1, *range(8, 17))]
    assert [(v, s) for q, _, v, s in got if q == 200] == [(v, 1.0) for v in (0, 1, *range(8, 16))]
    few = neighbours(df.where("vec_id in (0, 1, 200)")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in few) == [(0, 1, 1), (0, 2, 200), (200, 1, 0), (200, 2, 1)]
    assert neighbours(df.limit(0)).count() == 0


def test_many_cells_on_clustered_and_random_vectors(spark):
    """Recall over many cells and blocks; in clusters, a query visits few of the other cells."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) * 10
    clustered = centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 32)) * 0.3
    for points, few in ((clustered, True), (rng.standard_normal((4000, 32)), False)):
        rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours(df, block=100).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        want = brute(rows)
        assert sum(len({j for _, j in want[q]} & got[q]) for q in want) >= 0.9 * 10 * len(want)
        if few:
            celled = _celled(df, 100)
            queries = celled.where("vec_id % 100 = 0").selectExpr("*", "4.0D AS bound")
            assert _routed(queries, _ranges(celled)).count() <= 0.25 * 40 * len(want)


def test_pivots_are_the_least_hashes_and_few_rows_are_ordered(spark):
    from pyspark.sql import functions as F

    from veldt.llm.ann import _pivots

    df = spark.range(20_000).selectExpr("id AS vec_id", "array(double(id), 1D) AS embedding")
    hashes = sorted((r.h, r.vec_id) for r in df.select(F.xxhash64("vec_id").alias("h"), "vec_id").collect())
    got = sorted((r.k, r.embedding[0]) for r in _pivots(df, 1000).collect())
    assert got == [(i + 1, float(v)) for i, (_, v) in enumerate(hashes[:20])]
    assert sorted(r.embedding[0] for r in _pivots(df.limit(5), 1000).collect()) == [min((h, v) for h, v in hashes if v < 5)[1]]
    one = spark.range(5000).selectExpr("7L AS vec_id", "array(double(id % 3), 1D) AS embedding")  # one id, few vectors
    assert [(r.k, r.embedding) for r in _pivots(one, 1000).collect()] == [(1, [0.0, 1.0])]
