import math

import pytest

from veldt.operators import baseline as B
from veldt.plans import catalogue as C

SCHEMA = "company_id string, period string, as_of_date string, stage string, " + ", ".join(f"{f} double" for f in B.FIELDS)
FULL = dict(papers=21, valid_patents=1234, rd=16, revenue=100, ip=30, staff=200, contract=1500.5, negative_probability=0.196, applications=10, grants=3, intangible=1, net_assets=3, trl=7, core_revenue=70)
REFERENCES = "company_id string, metric_id string, evidence_id string, locator string, strength string, basis string"
GOVERNED = "evidence_id string, company_id string, strength string, basis string"


def request(company, stage="growth", period="2024", day="2024-07-01", **fields):
    values = FULL | fields
    return (company, period, day, stage, *[None if values[f] is None else float(values[f]) for f in B.FIELDS])


def evidence(spark, company):
    rows = [(company, m[0], f"e{i}", "p. 1", "direct", "") for i, m in enumerate(B.METRICS)]
    return B.eligible(spark.createDataFrame(rows, REFERENCES), spark.createDataFrame([(r[2], company, "direct", "") for r in rows], GOVERNED))


def found(spark, row, with_evidence=True):
    e = evidence(spark, row[0] if with_evidence else "another")
    df = B.metrics(spark.createDataFrame([row], SCHEMA), e, C.baseline_bands(spark))
    return {r.metric_id: r for r in df.collect()}, df


def test_a_full_request(spark):
    got, df = found(spark, request("a"))
    assert {m: r.value for m, r in got.items()} == {
        "tqi-001": 21.0, "tqi-002": 1234.0, "tqi-003": 16.0, "tqi-004": 15.0, "tqi-005": 1500.5, "tqi-006": 0.2, "tqc-001": 21.0, "tqc-002": 10.0,
        "tqc-003": 30.0, "tqc-004": 16.0, "tqc-005": 33.33, "tqc-006": 7.0, "tqc-007": 70.0, "tqc-008": 0.2,
    }
    assert {m: r.score for m, r in got.items() if r.score} == {"tqc-001": 25, "tqc-002": 60, "tqc-003": 60, "tqc-004": 25, "tqc-006": 25, "tqc-007": 60, "tqc-008": 25}
    assert got["tqi-002"].formula == "累计有效发明专利授权量=1,234 件。"
    assert got["tqi-003"].formula == "研发投入强度=16 ÷ 100 × 100%=16%。"
    assert got["tqi-004"].formula == "人均知识产权效率=30 ÷ (200 ÷ 100)=15 件/百名研发人员。"
    assert got["tqi-006"].formula.endswith("负面情感概率=0.196。") and got["tqc-006"].formula == "当前技术成熟度=7 级。"
    [t] = B.totals(df).collect()
    assert (t.quantified, t.quantified_weight, t.technology_weight, t.calibrated, t.with_band, t.status, t.calibration_status) == (6, 25, 25, 8, 7, "completed", "complete")


@pytest.mark.parametrize(("fields", "metric", "status", "errors"), [
    ({"papers": -1}, "tqi-001", "invalid-input", "papers:min"),
    ({"papers": -1.5}, "tqc-001", "invalid-input", "papers:integer;papers:min"),
    ({"papers": math.nan}, "tqi-001", "invalid-input", "papers:finite"),
    ({"trl": 10}, "tqc-006", "invalid-input", "trl:max"),
    ({"revenue": 0}, "tqi-003", "invalid-input", "revenue:zero"),
    ({"revenue": 0, "rd": None}, "tqi-003", "missing", ""),
    ({"revenue": math.inf, "rd": None}, "tqi-003", "invalid-input", "revenue:finite"),
    ({"staff": None}, "tqi-004", "missing", ""),
    ({"revenue": 0, "core_revenue": -2}, "tqc-007", "invalid-input", "core_revenue:min"),
])
def test_a_fault_stays_with_its_metrics(spark, fields, metric, status, errors):
    for with_evidence in (True, False):  # inputs are validated before evidence is asked for
        got, _ = found(spark, request("a", **fields), with_evidence)
        assert (got[metric].status, got[metric].errors, got[metric].value, got[metric].score) == (status, errors, None, None)
        assert got["tqc-005"].status == ("calculated" if with_evidence else "ineligible-evidence")


def test_evidence_that_may_not_carry(spark):
    rows = [("a", "tqi-001", e, at, s, b) for e, at, s, b in [
        ("good", "p. 1", "direct", ""), ("no place", " ", "direct", ""), ("inferred", "p. 1", "inferred", "why"), ("half", "p. 1", "inferred", ""),
        ("unfounded", "p. 1", "inferred", "why"), ("background", "p. 1", "background", "why"), ("stronger", "p. 1", "direct", ""), ("other's", "p. 1", "direct", ""), ("unknown", "p. 1", "direct", ""), (None, "p. 1", "direct", "")]]
    governed = [("good", "a", "direct", None), ("no place", "a", "direct", None), ("inferred", "a", "inferred", "why"), ("half", "a", "inferred", "why"), ("unfounded", "a", "inferred", " "),
                ("background", "a", "background", "why"), ("stronger", "a", "inferred", "why"), ("other's", "b", "direct", None)]
    got = B.eligible(spark.createDataFrame(rows, REFERENCES), spark.createDataFrame(governed, GOVERNED))
    assert sorted(r.evidence_id for r in got.collect()) == ["good", "inferred"]


def test_requests_that_are_refused(spark):
    rows = [request("a"), request(" "), request("b", period=None), request("c", day="soon"), request("d", day="2024-02-30"), request("e", stage="old"), request("f", stage=None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[0] for r in df.select(B.request_error()).collect()] == [None, "company", "period", "as-of-date", None, "stage", "stage"]
    assert {r.company_id for r in B.metrics(df, evidence(spark, "a"), C.baseline_bands(spark)).collect()} == {"a", "d"}
    assert B.totals(B.metrics(df.limit(0), evidence(spark, "a"), C.baseline_bands(spark))).count() == 0
