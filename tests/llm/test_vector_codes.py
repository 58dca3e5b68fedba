import hashlib
import math

import numpy as np
import pytest

from veldt.llm.vector_codes import CellIndex, bounds_of, most_of, vector_codes


def codes(rows, parts=8, entries=16, rounds=6):
    """Brute force of one length of vectors; rows: vec_id, vector, label."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(4096 * x) for x in r[1]] for r in good]
    size = len(whole[0])
    edges = bounds_of(size, parts)
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, whole[i]))
    codes_, errors, all_entries = [[] for _ in good], [0] * len(good), []
    for p in range(parts):
        own = [w[edges[p] : edges[p + 1]] for w in whole]
        book = [list(own[i]) for i in order[:entries]]

        def nearest(x):
            return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            to = [nearest(x)[1] for x in own]
            for e in range(len(book)):
                mine = [x for x, t in zip(own, to, strict=True) if t == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, x in enumerate(own):
            d, e = nearest(x)
            codes_[i].append(f"{e:02x}")
            errors[i] += d
        all_entries += [str(x) for e in book for x in e]
    digest = hashlib.sha256(",".join(all_entries).encode()).hexdigest()
    by_label = {}
    for r, e in zip(good, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(str((r[0], "".join(c), e, by_label[r[2]], digest)) for r, c, e in zip(good, codes_, errors, strict=True))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'c' AS code", "1 AS size", "0 AS n", "label AS own")


def result(df, **how):
    return sorted(str(tuple(r)) for r in vector_codes(df, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(16) * 3).round(3).tolist(), [None, 1, 2, 2][i % 4]) for i in range(300)]
    rows += [(3, rows[5][1], 1), (3, rows[5][1], 1), (None, rows[6][1], None), (400, [0.0] * 16, 2)]
    bad = [(500, None, 1), (501, [None] * 16, 1), (502, [float("nan")] * 16, None), (503, [1.0] * 15 + [float("inf")], 3)]
    for some in (rows, rows[:5], rows[:1]):
        assert result(frame(spark, some + bad).repartition(7)) == codes(some + bad)
    assert result(frame(spark, bad)) == [] and result(frame(spark, rows).limit(0)) == []


def test_given_table_by_columns_and_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    assert result(df) == codes(rows)
    assert result(df, parts=4, entries=5, rounds=2) == codes(rows, 4, 5, 2)


def test_lengths_have_their_own_codebooks(spark):
    rng = np.random.default_rng(2)
    of = {n: [(n * 1000 + i, rng.standard_normal(n).round(3).tolist(), n) for i in range(40)] for n in (3, 8, 11)}
    got = result(frame(spark, [r for rows in of.values() for r in rows]))
    assert got == sorted(x for rows in of.values() for x in codes(rows))
    assert "e3b0c442" in result(frame(spark, [(1, [], 1)]))[0]  # no components: the digest of nothing


def test_huge_components_count_as_the_largest(spark):
    rows = [(1, [1e300] + [0.0] * 7, 1), (2, [-1e300] + [0.0] * 7, 1), (3, [0.25] * 8, 2)]
    got = {r.vec_id: r for r in vector_codes(frame(spark, rows), entries=2, rounds=1).collect()}
    assert set(got) == {1, 2, 3} and all(0 <= r.error < 2**63 for r in got.values()) and most_of(8) * 2 < 2**31.6


@pytest.mark.parametrize("n, width, scale", [(16, 8, 50), (16, 1, 3), (3, 8, 10**6), (200, 4, 2000), (1, 2, 5), (16, 8, 1)])
def test_cells_bound_all_distances_and_find_the_nearest(n, width, scale):
    rng = np.random.default_rng(n + width)
    entries = rng.integers(-scale, scale + 1, (n, width))
    queries = np.concatenate([rng.integers(-2 * scale, 2 * scale + 1, (9000, width)), entries])
    index = CellIndex(entries)
    distance = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    low, high = index.bounds(queries)
    assert (low <= distance).all() and (distance <= high).all()
    entry, best = index.nearest(queries)
    assert (entry == distance.argmin(1)).all() and (best == distance.min(1)).all()
    if n == 16 and scale == 50:
        assert (low <= high.min(1)[:, None]).mean() < 0.6  # the bounds do rule entries out


def test_few_and_many_labels(spark):
    """Labels of very many, and of single, rows: totals by either way."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(2).tolist(), 7 if i % 3 == 0 else i) for i in range(4000)]
    got = vector_codes(frame(spark, rows), rounds=1).collect()
    total = {}
    label = {r[0]: r[2] for r in rows}
    for r in got:
        total[label[r.vec_id]] = total.get(label[r.vec_id], 0) + r.error
    assert len(got) == 4000 and all(r.label_error == total[label[r.vec_id]] for r in got)
