"""Six-dimension index from reviewed observations: latest review, rule check, provenance, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.text import period_key

AGREEMENT = 1e-4
LEAST_DIMENSIONS = 4


def latest_reviewed(observations: DataFrame) -> DataFrame:
    """The newest validated observation of each company and indicator.

    By the parsed period, then the review time, then the period's text; combined before the shuffle.
    Where any of a pair's periods can't be parsed, periods can't be compared, and the review time decides.
    """
    own = observations.where("status = 'validated'")
    rest = [c for c in own.columns if c not in ("company_id", "indicator_id")]
    later = [F.coalesce("reviewed_at", F.lit("")), F.coalesce("period", F.lit(""))]
    by_period = F.struct(F.coalesce(period_key(F.col("period")), F.lit(0)), *later)
    by = own.groupBy("company_id", "indicator_id").agg(
        F.max_by(F.struct(*rest), by_period).alias("p"), F.max_by(F.struct(*rest), F.struct(*later)).alias("t"), F.bool_and(period_key(F.col("period")).isNotNull()).alias("parsed")
    )
    return by.select("company_id", "indicator_id", F.when(F.col("parsed"), F.col("p")).otherwise(F.col("t")).alias("r")).select("company_id", "indicator_id", "r.*")


def agreeing(observations: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Observations whose stored score is that of their rule, within 1e-4; those without a rule are left out."""
    joined = observations.join(recomputed, "observation_id")
    return joined.where(F.abs(F.col("score") - F.col("rule_score")) <= AGREEMENT)


def proven(observations: DataFrame, bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Observations with a binding of the same company, indicator, period and unit to effective evidence.

    A binding that names an observation binds that one alone.
    """
    b = bindings.join(evidence.where("effective").select("evidence_id"), "evidence_id", "left_semi").select(
        "company_id", "indicator_id", F.trim("period").alias("_period"), F.trim("unit").alias("_unit"), F.col("observation_id").alias("_observation_id")
    )
    o = observations.withColumn("_period", F.trim("period")).withColumn("_unit", F.trim("unit"))
    keys = ["company_id", "indicator_id", "_period", "_unit"]
    hit = o.join(b, keys).where(F.col("_observation_id").isNull() | (F.col("_observation_id") == F.col("observation_id"))).select("observation_id").distinct()
    return observations.join(hit, "observation_id", "left_semi")


def dimension_means(scored: DataFrame) -> DataFrame:
    """Rounded mean of the scores of each company and dimension."""
    return scored.groupBy("company_id", "dimension_id").agg(F.floor(F.avg("score") + 0.5).alias("dimension_score"))


def overridden(dims: DataFrame, overrides: DataFrame, dimension: str = "technology") -> DataFrame:
    """Dimension scores with an accepted technology score in place of the mean."""
    o = overrides.select("company_id", F.lit(dimension).alias("dimension_id"), F.floor(F.col("override_score") + 0.5).alias("_o"))
    joined = dims.join(o, ["company_id", "dimension_id"], "full")
    return joined.select("company_id", "dimension_id", F.coalesce("_o", "dimension_score").alias("dimension_score"))


def accepted_override(enabled: Column, run_id: Column, current_run: Column, company: Column, own_company: Column, score: Column, reason: Column, reviewer: Column, day: Column) -> Column:
    """Whether a reviewed override holds: current run, own company, 0..100, reason, reviewer, a date."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return F.coalesce(
        enabled & (run_id == current_run) & (company == own_company) & score.between(0, 100) & filled(reason) & filled(reviewer) & F.try_to_timestamp(day).isNotNull(),
        F.lit(False),
    )


def index(dims: DataFrame) -> DataFrame:
    """Rounded mean of the dimensions of each company; null with fewer than four."""
    n = F.count("dimension_score")
    return dims.groupBy("company_id").agg(n.alias("assessable"), F.when(n >= LEAST_DIMENSIONS, F.floor(F.avg("dimension_score") + 0.5)).alias("index"))


def evidence_coverage(evidence: DataFrame) -> DataFrame:
    """Share of a company's effective evidence addresses that scoring uses, in percent; 0 without any."""
    effective = F.when(F.col("effective"), F.col("url"))
    used = F.when(F.col("effective") & F.col("scoring"), F.col("url"))
    by = evidence.groupBy("company_id").agg(F.count_distinct(used).alias("used"), F.count_distinct(effective).alias("known"))
    return by.select("company_id", "used", "known", F.coalesce(F.try_divide(F.col("used") * 100.0, F.col("known")), F.lit(0.0)).alias("coverage"))


def availability(referenced: Column, validated: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(F.try_divide(referenced * 100.0, validated), F.lit(0.0)))


def governance_summary(evidence: DataFrame) -> DataFrame:
    """Counts of one evidence table: all, effective, direct, inferred, background, scoring, distinct addresses."""
    s = F.col("strength")
    return evidence.agg(
        F.count("*").alias("records"), F.count_if("effective").alias("effective"), F.count_if(s == "direct").alias("direct"), F.count_if(s == "inferred").alias("inferred"),
        F.count_if(s == "background").alias("background"), F.count_if("scoring").alias("scoring"), F.count_distinct("url").alias("addresses"),
    )
