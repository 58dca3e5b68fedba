import math

import pytest
from pyspark.sql import functions as F

from veldt.functions import numeric
from veldt.operators import scoring as S


def percentiles(spark, values, direction):
    rows = [(f"c{i}", "g", "R", "cg", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "company_id string, benchmark_group string, indicator_id string, comparable_group string, v double")
    value = -F.col("v") if direction == "down" else F.col("v")
    p, _ = S.tie_percentile(value, ["benchmark_group", "indicator_id", "comparable_group"])
    return {r.v: r.p for r in df.withColumn("p", p).collect()}


def test_tie_percentiles(spark):
    assert percentiles(spark, [10, 20, 20, 40], "up")[20.0] == 0.5
    assert percentiles(spark, [10, 20, 20, 40], "down")[20.0] == 0.5
    assert percentiles(spark, [10, 20, 30], "down")[10.0] == 1.0
    assert percentiles(spark, [10], "up")[10.0] is None


def test_anchor_and_full_scores(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "p double")
    assert [r.s for r in df.select(S.anchor_score(F.col("p")).alias("s")).collect()] == [25.0, 50.0, 75.0, None]
    values = spark.createDataFrame([("a", float(v)) for v in (0, 25, 50, 75, 100)] + [("b", 1.0), ("b", 2.0)], "k string, numeric_value double")
    q = S.quantiles(values, ["k"])
    got = {r.k: (r.a, r.f) for r in q.select("k", S.historical_anchor(q).alias("a"), S.full_score(S.historical_anchor(q), F.lit(0.75)).alias("f")).collect()}
    assert got == {"a": (0.5, 62.5), "b": (None, None)}


def matrix(spark, rows):
    flat = [("g", f"c{i}", f"k{j}", x) for i, row in enumerate(rows) for j, x in enumerate(row)]
    return spark.createDataFrame(flat, "benchmark_group string, company_id string, column string, x double")


@pytest.mark.parametrize("method", ["critic", "entropy"])
def test_weights_add_up_to_one(spark, method):
    w = S.objective_weights(matrix(spark, [[0.0, 0.5, 1.0], [0.5, 1.0, 0.0], [1.0, 0.0, 0.5]]), method).collect()
    assert len(w) == 3 and abs(sum(r.weight for r in w) - 1) < 1e-5


def brute_critic(rows):
    columns = list(zip(*rows, strict=True))
    active = [j for j, c in enumerate(columns) if sum(x is not None for x in c) >= 2]

    def std(c):
        c = [x for x in c if x is not None]
        m = sum(c) / len(c)
        return math.sqrt(sum((x - m) ** 2 for x in c) / len(c))

    def rho(a, b):
        pairs = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
        if len(pairs) < 2:
            return 0
        mx, my = (sum(p[i] for p in pairs) / len(pairs) for i in (0, 1))
        d = math.sqrt(sum((x - mx) ** 2 for x, _ in pairs) * sum((y - my) ** 2 for _, y in pairs))
        return sum((x - mx) * (y - my) for x, y in pairs) / d if d else 0

    info = {j: std(columns[j]) * sum(1 - abs(rho(columns[j], columns[k])) for k in active if k != j) for j in active}
    total = sum(info.values())
    return {f"k{j}": v / total if total else 1 / len(info) for j, v in info.items()}


@pytest.mark.parametrize(
    "rows",
    [
        [[0.1, 0.5, 0.5, None], [0.9, 0.5, 0.25, None], [0.4, 0.5, None, 0.3], [0.3, 0.5, 0.75, None]],  # constant column, single value
        [[0.5, 0.5], [0.5, 0.5]],
    ],
)
def test_critic_with_missing_values(spark, rows):
    got = {r["column"]: r.weight for r in S.objective_weights(matrix(spark, rows), "critic").collect()}
    want = brute_critic(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_single_company_group_has_no_weights(spark):
    assert S.objective_weights(matrix(spark, [[0.1, 0.2]]), "critic").count() == 0


def test_latest_takes_finite_values_by_date_then_id(spark):
    rows = [("c", "m", "2024-01-01", "o1", 1.0), ("c", "m", "2024-02-01", "o2", 2.0), ("c", "m", "2024-02-01", "o3", 3.0), ("c", "m", "2024-03-01", "o4", float("nan")), ("c", "m", "2024-03-01", "o5", None), ("c", "n", None, "o6", float("inf"))]
    df = spark.createDataFrame(rows, "company_id string, metric_name string, as_of_date string, observation_id string, numeric_value double")
    assert [tuple(r) for r in S.latest(df).collect()] == [("c", "m", "2024-02-01", "o3", 3.0)]


def test_peers_need_the_same_first_candidate(spark):
    candidates = spark.createDataFrame([("R", "finance", "up", 0, "m1", "g1"), ("R", "finance", "up", 1, "m2", "g2")], "indicator_id string, dimension_id string, direction string, rank int, metric_name string, comparable_group string")
    newest = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", 5.0), ("b", "m2", 6.0)], "company_id string, metric_name string, numeric_value double")
    companies = spark.createDataFrame([("a", "g"), ("b", "g")], "company_id string, benchmark_group string")
    got = {r.company_id: (r.metric_name, r.sample_size, r.risk_score, r.status) for r in S.peer_scores(S.resolved(newest, candidates), companies).collect()}
    assert got == {"a": ("m1", 1, None, "missing"), "b": ("m2", 1, None, "missing")}


def test_exact_and_fast_rounding(spark):
    df = spark.createDataFrame([(1.005,), (1.335,), (0.125,), (2.5,), (-2.5,), (None,)], "x double")
    assert [r.y for r in df.select(numeric.exact_fixed(F.col("x"), F.lit(2)).alias("y")).collect()] == [1.0, 1.33, 0.13, 2.5, -2.5, None]
    assert [r.y for r in df.select(F.floor(F.col("x") + 0.5).alias("y")).collect()] == [1, 1, 0, 3, -2, None]


def test_ranged_percentiles_are_those_of_windows(spark):
    import random

    draw = random.Random(5)
    some = [0.0, -0.0, 1.0, -1.0, 1e-300, -1e300, 64.0, 63.999999999999993, 64.00000000000001, 5e-324, 1.7e308]
    values = [(draw.choice("ab"), draw.choice(some) if draw.random() < 0.5 else draw.choice([1, -1]) * 2 ** draw.uniform(-12, 12)) for _ in range(3000)]
    rows = [(i, k, x) for i, (k, x) in enumerate(values)] + [(-1, "alone", 3.0), (-2, "a", None), (-3, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, x double")
    got = {r.id: (r.sample_size, r.risk_percentile) for r in S.ranged_percentiles(df, "x", ["k"]).collect()}
    p, n = S.tie_percentile(F.col("x") + 0.0, ["k"])
    plain = df.where("k is not null and x is not null")
    want = {r.id: (r.n, r.p) for r in plain.select("id", n.alias("n"), p.alias("p")).collect()}
    assert got == want | {-2: (None, None), -3: (None, None)}
    assert got[-1] == (1, None) and len(got) == len(rows)


def test_ranges_never_fall(spark):
    df = spark.range(-40000, 40000).select((F.col("id") / 37.0).alias("x"), S.value_range(F.col("id") / 37.0).alias("r")).orderBy("x")
    found = [r.r for r in df.collect()]
    assert found == sorted(found) and len(set(found)) > 1000
