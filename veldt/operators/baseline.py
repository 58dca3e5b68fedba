"""The technology baseline: six official metrics, eight calibrations against bands, and their totals.

A request is a row: company_id, period, as_of_date, stage, and a nullable double for each of FIELDS (null: not submitted).
A metric's inputs are validated before anything is asked of its evidence, and one metric's fault leaves the others alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.dates import is_date
from veldt.functions.numeric import finite, half_up
from veldt.functions.text import number_text
from veldt.operators.technology import holds

# A field's label, whether it is a whole number, its least and its largest value.
FIELDS = {
    "papers": ("年度 SCI/核心期刊论文数", True, 0, None),
    "valid_patents": ("累计有效发明专利授权量", True, 0, None),
    "rd": ("研发费用", False, 0, None),
    "revenue": ("营业收入", False, 0, None),
    "ip": ("知识产权拥有件数", True, 0, None),
    "staff": ("研发人员数", True, 0, None),
    "contract": ("年度技术合同成交总额", False, 0, None),
    "negative_probability": ("年报技术风险关键词负面情感概率", False, 0, 1),
    "applications": ("累计发明专利申请量", True, 0, None),
    "grants": ("累计发明专利授权量", True, 0, None),
    "intangible": ("无形资产", False, 0, None),
    "net_assets": ("净资产", False, 0, None),
    "trl": ("当前技术成熟度（TRL）", True, 1, 9),
    "core_revenue": ("核心技术产品收入", False, 0, None),
}

# Metric, field, denominator (a percentage, or per hundred), rule of its band, unit, name in its formula if not the field's.
METRICS = [
    ("tqi-001", "papers", None, None, "篇", None),
    ("tqi-002", "valid_patents", None, None, "件", None),
    ("tqi-003", "rd", "revenue", None, "%", "研发投入强度"),
    ("tqi-004", "ip", "staff", None, "件/百名研发人员", "人均知识产权效率"),
    ("tqi-005", "contract", None, None, "万元", None),
    ("tqi-006", "negative_probability", None, None, "", "年报技术风险关键词经已记录的文本模型处理后，负面情感概率"),
    ("tqc-001", "papers", None, "papers", "篇", None),
    ("tqc-002", "applications", None, "applications", "件", None),
    ("tqc-003", "grants", "applications", "grant_rate", "%", "专利授权率"),
    ("tqc-004", "rd", "revenue", "rd_intensity", "%", "研发投入强度"),
    ("tqc-005", "intangible", "net_assets", None, "%", "无形资产占净资产比"),
    ("tqc-006", "trl", None, "trl", "级", "当前技术成熟度"),
    ("tqc-007", "core_revenue", "revenue", "core_revenue", "%", "核心技术产品收入占比"),
    ("tqc-008", "negative_probability", None, "negative_probability", "", "年报技术风险关键词经已记录的文本模型处理后，负面情感概率"),
]

# Weights of the official metrics in each stage of a company's life.
WEIGHTS = {"startup": (4, 6, 7, 6, 5, 2), "growth": (3, 6, 6, 5, 3, 2), "stable": (2, 5, 5, 4, 3, 1)}

OFFICIAL = 6
BANDED = 7


def request_error() -> Column:
    """The first rule that a request breaks, or null: company, period, as-of-date, stage."""
    blank = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    return (
        F.when(blank("company_id"), "company").when(blank("period"), "period").when(~is_date(F.col("as_of_date")), "as-of-date")
        .when(~F.coalesce(F.col("stage").isin(*WEIGHTS), F.lit(False)), "stage")
    )


def _field_errors(field: str) -> Column:
    _, whole, least, most = FIELDS[field]
    x = F.col(field)
    known = finite(x)
    found = [F.when(x.isNotNull() & ~known, f"{field}:finite")]
    if whole:
        found.append(F.when(known & (x != F.floor(x)), f"{field}:integer"))
    found.append(F.when(known & (x < least), f"{field}:min"))
    if most is not None:
        found.append(F.when(known & (x > most), f"{field}:max"))
    return F.array_compact(F.array(*found))


def _metric(metric: str, field: str, below: str | None, band: str | None, unit: str, name: str | None) -> Column:
    x, errors = F.col(field), _field_errors(field)
    if below is None:
        value = x
        text = F.concat(F.lit((name or FIELDS[field][0]) + "="), number_text(x, 2 if unit else 3), F.lit(f" {unit}。" if unit else "。"))
    else:
        y, hundred = F.col(below), unit != "%"
        errors = F.concat(errors, _field_errors(below))
        both = x.isNotNull() & y.isNotNull()
        errors = F.when((F.size(errors) == 0) & both & (y == 0), F.array(F.lit(f"{below}:zero"))).otherwise(errors)
        value = F.try_divide(x, y / 100.0) if hundred else F.try_divide(x, y) * 100.0
        shown = number_text(half_up(value, 2))
        middle = (" ÷ (", " ÷ 100)=", f" {unit}。") if hundred else (" ÷ ", " × 100%=", "%。")
        text = F.concat(F.lit(name + "="), number_text(x), F.lit(middle[0]), number_text(y), F.lit(middle[1]), shown, F.lit(middle[2]))
    at = int(metric[-1]) - 1
    weight = F.lit(None).cast("int")
    if metric.startswith("tqi"):
        for stage, weights in WEIGHTS.items():
            weight = F.when(F.col("stage") == stage, weights[at]).otherwise(weight)
    return F.struct(
        F.lit(metric).alias("metric_id"), F.lit(band).cast("string").alias("rule_id"), weight.alias("weight"), errors.alias("errors"),
        value.alias("input"), text.alias("formula"),
    )


def eligible(references: DataFrame, governed: DataFrame) -> DataFrame:
    """The references that may carry a metric: located, governed for the same company with the same strength, and direct,
    or inferred with a basis on both sides.

    references: company_id, metric_id, evidence_id, locator, strength, basis. governed: evidence_id, company_id, strength, basis,
    one row an id. Both sides are shuffled by the evidence's id unless one is small.
    """
    g = governed.select("evidence_id", F.col("company_id").alias("g_company"), F.col("strength").alias("g_strength"), F.col("basis").alias("g_basis"))
    full = lambda name: F.coalesce(F.trim(name), F.lit("")) != ""
    carries = (F.col("strength") == "direct") | ((F.col("strength") == "inferred") & full("basis") & full("g_basis"))
    return (
        references.where(full("evidence_id") & full("locator")).join(g, "evidence_id")
        .where((F.col("company_id") == F.col("g_company")) & (F.col("strength") == F.col("g_strength")) & carries)
        .select("company_id", "metric_id", "evidence_id", "strength")
    )


def metrics(requests: DataFrame, evidence: DataFrame, bands: DataFrame) -> DataFrame:
    """Fourteen rows a valid request: status, value, band and score.

    evidence: what `eligible` gives; it is counted before it is joined, so a company with very much of it costs nothing more.
    bands: rule_id, low_op, low, medium_op, medium; seven rows.
    The status is invalid-input, else missing, else ineligible-evidence, else calculated. Only a calculated metric has a value;
    tqc-005 has no band, so it has no score.
    """
    each = requests.where(request_error().isNull()).select("company_id", "period", F.inline(F.array(*[_metric(*m) for m in METRICS])))
    counted = evidence.groupBy("company_id", "metric_id").agg(F.count("*").alias("n_evidence"))
    joined = each.join(counted, ["company_id", "metric_id"], "left").join(F.broadcast(bands), "rule_id", "left")
    v, known = F.col("input"), F.coalesce("n_evidence", F.lit(0))
    status = (
        F.when(F.size("errors") > 0, "invalid-input").when(v.isNull(), "missing").when(known == 0, "ineligible-evidence").otherwise("calculated")
    )
    done = F.col("status") == "calculated"
    band = F.when(holds(v, F.col("low_op"), F.col("low")), "low").when(holds(v, F.col("medium_op"), F.col("medium")), "medium").otherwise("high")
    out = joined.withColumn("status", status).withColumn("risk_band", F.when((F.col("status") == "calculated") & F.col("rule_id").isNotNull(), band))
    score = F.when(F.col("risk_band") == "low", 25).when(F.col("risk_band") == "medium", 60).when(F.col("risk_band") == "high", 85)
    return out.select(
        "company_id", "period", "metric_id", "status", F.when(done, half_up(v, 2)).alias("value"), "weight", "risk_band", score.alias("score"),
        F.when(done, known).otherwise(F.lit(0)).cast("long").alias("n_evidence"), F.array_join("errors", ";").alias("errors"), F.when(done, F.col("formula")).alias("formula"),
    )


def totals(found: DataFrame) -> DataFrame:
    """Counts and weights of each request's metrics; there is no total score, calibrations stay observations."""
    official, done = F.col("metric_id").startswith("tqi"), F.col("status") == "calculated"
    by = found.groupBy("company_id", "period").agg(
        F.count_if(official & done).alias("quantified"), F.coalesce(F.sum(F.when(official & done, F.col("weight"))), F.lit(0)).cast("long").alias("quantified_weight"),
        F.sum("weight").cast("long").alias("technology_weight"), F.count_if(~official & done).alias("calibrated"), F.count("score").alias("with_band"),
        F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "invalid-input").alias("invalid"), F.count_if(F.col("status") == "ineligible-evidence").alias("ineligible"),
    )
    calibration = F.when(F.col("with_band") == 0, "pending").when(F.col("with_band") == BANDED, "complete").otherwise("partial")
    return by.select("*", F.when(F.col("quantified") == OFFICIAL, "completed").otherwise("partial").alias("status"), calibration.alias("calibration_status"))
