"""Technology scores: indicator formulas, incident overlay, forced floors, and the baseline's bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.numeric import clamp, month_gap, step_decay
from veldt.plans.catalogue import HIGH_RISK, LOW_RISK, MEDIUM_RISK

LEAST_WEIGHT = 70
FORCED_FLOOR = 85


def two_digits(x: Column) -> Column:
    """Clamp to 0..100, round half up to 2 digits."""
    return F.floor(clamp(x, 0, 100) * 100 + 0.5) / 100.0


def citation_risk(citation: Column, quality: Column, patent: Column, conversion: Column, no_core_paper: Column, unmappable: Column) -> Column:
    risk = two_digits(100 - (0.30 * citation + 0.20 * quality + 0.25 * patent + 0.25 * conversion))
    return F.when(no_core_paper | unmappable, F.greatest(risk, F.lit(60.0))).otherwise(risk)


def patent_risk(citation: Column, family: Column, legal: Column, coverage: Column) -> Column:
    return two_digits(100 - (0.35 * citation + 0.25 * family + 0.20 * legal + 0.20 * coverage))


def investment_risk(investment: Column, update: Column) -> Column:
    return two_digits(100 - (0.4 * investment + 0.6 * update))


def readiness_risk(current: Column, target: Column, done: Column, due: Column) -> Column:
    level = F.greatest(F.lit(0.0), 100 - 25 * F.greatest(F.lit(0.0), target - current))
    return two_digits(100 - (0.6 * level + 0.4 * 100 * F.try_divide(done, due)))


def conversion_risk(converted: Column, completed: Column) -> Column:
    return two_digits(100 - 100 * F.try_divide(converted, completed))


def validation_risk(third: Column, customer: Column, independent: Column, own: Column, critical: Column, passed: Column, required: Column) -> Column:
    proof = F.try_divide(third + 0.8 * customer + 0.5 * independent + 0.2 * own, critical) * 100
    return two_digits(100 - (0.4 * proof + 0.6 * 100 * F.try_divide(passed, required)))


def dependency_risk(outside_standard: Column, outside_high: Column, standard: Column, high: Column) -> Column:
    return two_digits(100 * F.try_divide(outside_standard + 2 * outside_high, standard + 2 * high))


def base_score(risks: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the scored indicators of each company; null under 70 points of weight."""
    joined = risks.where("risk is not null").join(F.broadcast(weights), "indicator_id")
    by = joined.groupBy("company_id").agg(F.sum("weight").alias("coverage"), F.sum(F.col("weight") * F.col("risk")).alias("total"))
    return by.select("company_id", "coverage", F.when(F.col("coverage") >= LEAST_WEIGHT, two_digits(F.col("total") / F.col("coverage"))).alias("base_score"))


def incident_index(severity: Column, responsibility: Column, day: Column, snapshot: Column) -> Column:
    """Severity 0..10 times the share of responsibility times the decay by age."""
    share = F.when(responsibility == "primary", 1.0).when(responsibility == "secondary", 0.5).when(responsibility == "related", 0.25).otherwise(0.0)
    return two_digits(severity * share * step_decay(month_gap(snapshot, day)))


def incident_floor(index: Column) -> Column:
    return F.when(index <= 0, 0).when(index <= 2, 40).when(index <= 5, 60).otherwise(FORCED_FLOOR)


def incident_overlay(incidents: DataFrame) -> DataFrame:
    """The worst incident of each company, the first of equals, and the floor it sets.

    incidents: company_id, position, incident_id, index, severity, responsibility, concealed, repeated.
    """
    worst = F.max_by(F.struct("incident_id", "index"), F.struct(F.col("index"), -F.col("position")))
    forced = F.col("concealed") | F.col("repeated") | ((F.col("severity") >= 8) & (F.col("responsibility") == "primary"))
    by = incidents.groupBy("company_id").agg(worst.alias("w"), F.bool_or(forced).alias("forced"))
    return by.select("company_id", "w.incident_id", F.col("w.index").alias("incident_index"), incident_floor(F.col("w.index")).alias("floor"), "forced")


# What forces a company's score to the floor, by indicator; the last joins its causes.
FORCED = {
    "kci-008": "核心专利大面积失效或无法覆盖主营产品",
    "kci-009": "核心技术连续3年无有效更新",
    "kci-010": "TRL 仅为自评且缺少实验或示范证据",
    "kci-012": "存在强制或安全关键测试失败",
    "kci-013": "关键技术外部依赖红旗：",
}
DEPENDENCY_CAUSES = (("single_source", "不可替代高影响单一来源"), ("export_restriction", "出口限制"), ("license_risk", "关键许可证不可续期"))


def forced_reasons(flags: DataFrame) -> DataFrame:
    """company_id, reasons: why an indicator's own inputs force the floor, in indicator order.

    flags: company_id and booleans patent_failure (kci-008), stale (kci-009), self_assessed (kci-010),
    safety_failure (kci-012), single_source, export_restriction, license_risk (kci-013). A null flag is no reason.
    """
    one = lambda flag, indicator: F.when(F.col(flag), FORCED[indicator])
    causes = F.concat_ws("、", *[F.when(F.col(flag), cause) for flag, cause in DEPENDENCY_CAUSES])
    reasons = F.array(
        one("patent_failure", "kci-008"), one("stale", "kci-009"), one("self_assessed", "kci-010"), one("safety_failure", "kci-012"),
        F.when(causes != "", F.concat(F.lit(FORCED["kci-013"]), causes)),
    )
    return flags.select("company_id", F.array_compact(reasons).alias("reasons"))


def final_score(base: DataFrame, overlay: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """The base score, raised to the incident's floor, and to 85 where an incident or an indicator's reason forces it."""
    joined = base.join(overlay, "company_id", "left")
    if reasons is not None:
        joined = joined.join(reasons, "company_id", "left").withColumn("forced", F.coalesce("forced", F.lit(False)) | (F.coalesce(F.size("reasons"), F.lit(0)) > 0))
    raised = F.greatest(F.col("base_score"), F.coalesce("floor", F.lit(0)).cast("double"))
    forced = F.when(F.coalesce("forced", F.lit(False)), F.greatest(raised, F.lit(float(FORCED_FLOOR)))).otherwise(raised)
    return joined.select("company_id", "coverage", "base_score", F.coalesce("incident_index", F.lit(0.0)).alias("incident_index"), F.when(F.col("base_score").isNotNull(), forced).alias("score"))


def indicator_status(present: Column, eligible: Column, valid: Column, evidence_first: bool = True) -> Column:
    """missing, ineligible-evidence, invalid-input or scored; the baseline checks validity first of all."""
    if evidence_first:
        return F.when(~present, "missing").when(~eligible, "ineligible-evidence").when(~valid, "invalid-input").otherwise("scored")
    return F.when(~valid, "invalid-input").when(~present, "missing").when(~eligible, "ineligible-evidence").otherwise("calculated")


def holds(value: Column, op: Column, bound: Column) -> Column:
    """Whether a value meets a bound by an operator's sign."""
    return (
        F.when(op == ">", value > bound).when(op == ">=", value >= bound).when(op == "<", value < bound).when(op == "<=", value <= bound).otherwise(value == bound)
    )


def banded(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Score 25, 60 or 85 of each value by its rule's two bounds; rules are a small table, broadcast.

    values: entity, rule_id, value. A null value has no score.
    """
    joined = values.join(F.broadcast(rules), "rule_id")
    v = F.col("value")
    score = F.when(holds(v, F.col("low_op"), F.col("low")), LOW_RISK).when(holds(v, F.col("medium_op"), F.col("medium")), MEDIUM_RISK).otherwise(HIGH_RISK)
    return joined.select("entity", "rule_id", "value", F.when(v.isNotNull(), score).alias("score"))


def official_metrics(df: DataFrame) -> DataFrame:
    """The six official baseline metrics of each row of inputs."""
    return df.select(
        "company_id", F.col("papers").cast("double").alias("papers"), F.col("valid_patents").cast("double").alias("valid_patents"),
        two_or_null(F.lit(100.0) * F.try_divide("rd", "revenue")).alias("rd_intensity"),
        two_or_null(F.try_divide("ip", F.col("staff") / 100.0)).alias("ip_per_hundred"),
        F.col("contract").cast("double").alias("contract_value"), F.col("negative_probability"),
    )


def two_or_null(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100.0
