import pytest
from pyspark.sql import functions as F

from veldt.functions import numeric, text
from veldt.operators import fixedweight as W
from veldt.operators import merge as M
from veldt.operators import technology as T
from veldt.plans import catalogue as C

# Indicator, weight, risk, status, confidence of the published example assessment (fixed values).
EXAMPLE = [
    ("T01", 4, 25, "partial", 0.75), ("T02", 5, 10, "complete", 0.95), ("T03", 6, 20, "complete", 0.95), ("T04", 5, 30, "partial", 0.75),
    ("T05", 5, 20, "complete", 0.80), ("C01", 5, 5, "complete", 0.95), ("C02", 4, 20, "complete", 0.90), ("C03", 11, 75, "complete", 0.95),
    ("F01", 6, 5, "complete", 0.95), ("F02", 4, 5, "complete", 0.95), ("F03", 4, 10, "complete", 0.95), ("F04", 6, 80, "complete", 0.95),
    ("E01", 7, 70, "partial", 0.65), ("E02", 4, 5, "complete", 0.95), ("E03", 9, 85, "complete", 0.95), ("P01", 5, 25, "complete", 0.95),
    ("P02", 4, 20, "partial", 0.60), ("P03", 6, 10, "complete", 0.95),
]
DIMENSION = {i: d for i, d, _ in C.FIXED_WEIGHTS}
COLUMNS = "company_id string, indicator_id string, dimension_id string, weight int, risk_score double, data_status string, coverage_factor double, evidence_confidence double, n_evidence int"


def example(spark, missing=()):
    rows = [("x", i, DIMENSION[i], w, None if i in missing else float(s), "missing" if i in missing else status, 0.75 if status == "partial" else 1.0, c, 0 if i in missing else 1) for i, w, s, status, c in EXAMPLE]
    return spark.createDataFrame(rows, COLUMNS)


def test_example_assessment(spark):
    base = W.baseline(example(spark)).first()
    assert (base.baseline_score, base.risk_level, base.status, base.confidence, base.evidence_coverage) == (35.6, "medium", "scored", 0.8875, 0.95)
    dims = {r.dimension_id: r.score for r in W.dimensions(example(spark), C.fixed_dimensions(spark)).collect()}
    assert dims == {"technology": 20.8, "compliance": 46.5, "finance": 28.5, "external": 63.75, "personnel-governance": 17.6667}
    reviewed = W.review_status(W.baseline(example(spark)), W.dimensions(example(spark), C.fixed_dimensions(spark))).first()
    assert reviewed.review_status == "ready"


def test_missing_indicator_is_left_out(spark):
    base = W.baseline(example(spark, {"T01"})).first()
    assert (base.baseline_score, base.scored_weight, base.confidence, base.evidence_coverage, base.status) == (36.0417, 96, 0.8575, 0.92, "partial")


def test_noise_path_is_excluded(spark):
    edge = "array<struct<strength:double,time_decay:double,business_relevance:double>>"
    paths = spark.createDataFrame([("direct", 85.0, [(1.0, 1.0, 1.0)]), ("noise", 50.0, [(0.1, 0.7, 0.5)])], f"path_id string, event_risk_score double, edges {edge}")
    got = {r.path_id: (r.coefficient, r.candidate_risk, r.included) for r in W.propagation(paths).collect()}
    assert got == {"direct": (1.0, 85.0, True), "noise": (0.035, 1.75, False)}


@pytest.mark.parametrize(
    "change, rule",
    [
        (lambda d: d.withColumn("weight", F.when(F.col("indicator_id") == "T01", 9).otherwise(F.col("weight"))), "wrong-weight"),
        (lambda d: d.withColumn("risk_score", F.when(F.col("indicator_id") == "T01", 101.0).otherwise(F.col("risk_score"))), "score-out-of-range"),
        (lambda d: d.withColumn("dimension_id", F.when(F.col("indicator_id") == "T01", "finance").otherwise(F.col("dimension_id"))), "wrong-dimension"),
        (lambda d: d.withColumn("coverage_factor", F.when(F.col("indicator_id") == "T01", 1.5).otherwise(F.col("coverage_factor"))), "coverage-out-of-range"),
        (lambda d: d.where("indicator_id <> 'T01'"), "absent-indicator"),
        (lambda d: d.unionByName(d.where("indicator_id = 'T01'")), "duplicate-indicator"),
    ],
)
def test_each_request_error_is_found_alone(spark, change, rule):
    evidence = spark.createDataFrame([("x", "e1", "direct", "https://a.example/b")], "company_id string, evidence_id string, strength string, url string")
    weights = C.fixed_weights(spark)
    assert W.request_errors(example(spark), evidence, weights).count() == 0
    assert {r.rule for r in W.request_errors(change(example(spark)), evidence, weights).collect()} == {rule}


def test_technology_formulas(spark):
    n = F.lit
    one = spark.range(1).select(
        T.readiness_risk(n(7), n(9), n(5), n(10)).alias("trl"),
        T.validation_risk(n(2), n(2), n(2), n(2), n(10), n(8), n(10)).alias("validation"),
        T.dependency_risk(n(2), n(1), n(6), n(2)).alias("dependency"),
        T.incident_index(n(8), n("secondary"), n("2026-01-01").cast("date"), n("2026-08-01").cast("date")).alias("incident"),
        T.incident_floor(n(4.0)).alias("floor"),
    ).first()
    assert tuple(one) == (50.0, 32.0, 40.0, 4.0, 60)


def test_technology_needs_seventy_points(spark):
    weights = spark.createDataFrame(C.TECHNOLOGY_WEIGHTS, "indicator_id string, weight int")
    rows = [("five", i, 50.0) for i in ("kci-006", "kci-007", "kci-008", "kci-009", "kci-010")] + [("six", i, 50.0) for i in ("kci-006", "kci-007", "kci-008", "kci-009", "kci-010", "kci-011")]
    got = {r.company_id: (r.coverage, r.base_score) for r in T.base_score(spark.createDataFrame(rows, "company_id string, indicator_id string, risk double"), weights).collect()}
    assert got == {"five": (55, None), "six": (70, 50.0)}


def test_thresholds_at_their_bounds(spark):
    rows = [("e", "kci-004", v) for v in (30.0, 30.1, 10.0, 9.9)] + [("e", "kci-026", v) for v in (10.1, 10.0, -10.0, -10.1)] + [("e", "kci-039", v) for v in (0.0, 1.0, 2.0, None)]
    got = sorted((r.rule_id, r.value if r.value is not None else 99.0, r.score) for r in T.banded(spark.createDataFrame(rows, "entity string, rule_id string, value double"), C.threshold_rules(spark)).collect())
    assert got == [("kci-004", 9.9, 85), ("kci-004", 10.0, 60), ("kci-004", 30.0, 60), ("kci-004", 30.1, 25), ("kci-026", -10.1, 85), ("kci-026", -10.0, 60), ("kci-026", 10.0, 60), ("kci-026", 10.1, 25), ("kci-039", 0.0, 25), ("kci-039", 1.0, 60), ("kci-039", 2.0, 85), ("kci-039", 99.0, None)]


def test_upsert_keeps_the_first_creation(spark):
    state = spark.createDataFrame([("a", 1, "2024")], "id string, value int, created string")
    changes = spark.createDataFrame([("a", 2, "2025", 1), ("a", 3, "2026", 2), ("b", 9, "2026", 1)], "id string, value int, created string, version long")
    assert sorted(tuple(r) for r in M.upserted(state, changes, ["id"], ["created"]).collect()) == [("a", 3, "2024"), ("b", 9, "2026")]


def test_surrogate_keys_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    rows = M.surrogate_keys(df, ["x"], 50).collect()
    assert sorted((r.x, r.key) for r in rows) == [(i, 51 + i) for i in range(1000)]


def test_text_functions(spark):
    one = spark.range(1).select(
        text.csv_field(F.lit('=1+"a"')).alias("a"), text.portable_path(F.lit("see C:\\Users\\me\\x\\f.pdf")).alias("b"), text.fnv1a(F.lit("hello")).alias("c"),
        text.first_number(F.lit("about -1,234.5 yuan")).alias("d"), text.http_url(F.lit("ftp://x")).alias("e"), text.ellipsis(F.lit("abcdef"), 4).alias("f"), text.aliases(F.lit(" a; ;b")).alias("g"),
        numeric.month_gap(F.lit("2026-08-01").cast("date"), F.lit("2026-07-31").cast("date")).alias("h"),
    ).first()
    assert one.a == '"\'=1+""a"""' and one.b == "see external-source/f.pdf" and one.c == _fnv("hello") and one.d == -1234.5 and one.e is False and one.f == "abc…" and one.g == ["a", "b"] and one.h == 1


def _fnv(s):
    h = 0x811C9DC5
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193) % 2**32
    return f"{h:08x}"
