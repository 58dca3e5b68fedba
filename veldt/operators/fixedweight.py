"""Fixed-weight, evidence-backed scoring of assessments: baseline, coverage, dimensions, paths, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.numeric import half_up_eps, risk_level
from veldt.functions.text import http_url

REVIEW_COVERAGE = 0.7
LEAST_COEFFICIENT = 0.05
STATUSES = ["complete", "partial", "missing"]
STRENGTHS = ["direct", "inferred", "background"]


def effective_evidence(strength: Column, basis: Column) -> Column:
    """Direct evidence, or inferred evidence that states its basis; background never counts."""
    return (strength == "direct") | ((strength == "inferred") & (F.length(F.trim(F.coalesce(basis, F.lit("")))) > 0))


def baseline(indicators: DataFrame) -> DataFrame:
    """One row per company: baseline score, level, coverage, confidence, status.

    indicators: company_id, indicator_id, dimension_id, weight, risk_score (null if missing),
    coverage_factor, evidence_confidence, n_evidence (effective pieces). Missing indicators count in
    neither part of the score; coverage and confidence are out of all 100 points of weight.
    """
    scored = F.col("risk_score").isNotNull()
    proven = scored & (F.col("n_evidence") > 0)
    by = indicators.groupBy("company_id").agg(
        F.sum(F.when(scored, F.col("weight") * F.col("risk_score"))).alias("total"),
        F.coalesce(F.sum(F.when(scored, F.col("weight"))), F.lit(0)).alias("scored_weight"),
        F.coalesce(F.sum(F.when(proven, F.col("weight") * F.col("coverage_factor"))), F.lit(0.0)).alias("covered"),
        F.coalesce(F.sum(F.when(proven, F.col("weight") * F.col("evidence_confidence"))), F.lit(0.0)).alias("confident"),
        F.count_if(~scored).alias("missing"),
    )
    score = half_up_eps(F.try_divide("total", "scored_weight"), 4)
    out = by.withColumn("baseline_score", score)
    status = F.when(F.col("baseline_score").isNull(), "insufficient-data").when(F.col("missing") > 0, "partial").otherwise("scored")
    return out.select(
        "company_id", "baseline_score", risk_level(F.col("baseline_score")).alias("risk_level"), "scored_weight",
        half_up_eps(F.col("scored_weight") / 100.0, 4).alias("weight_coverage"), half_up_eps(F.col("covered") / 100.0, 4).alias("evidence_coverage"),
        half_up_eps(F.col("confident") / 100.0, 4).alias("confidence"), "missing", status.alias("status"),
    )


def dimensions(indicators: DataFrame, weights: DataFrame) -> DataFrame:
    """Score of each dimension of each company, null where nothing of it is scored."""
    scored = F.col("risk_score").isNotNull()
    by = indicators.groupBy("company_id", "dimension_id").agg(
        F.sum(F.when(scored, F.col("weight") * F.col("risk_score"))).alias("total"), F.sum(F.when(scored, F.col("weight"))).alias("scored_weight")
    )
    joined = by.join(F.broadcast(weights), "dimension_id")
    return joined.select(
        "company_id", "dimension_id", half_up_eps(F.try_divide("total", "scored_weight"), 4).alias("score"),
        F.coalesce("scored_weight", F.lit(0)).alias("scored_weight"), half_up_eps(F.coalesce("scored_weight", F.lit(0)) / F.col("dimension_weight"), 4).alias("coverage"),
    )


def contributions(indicators: DataFrame) -> DataFrame:
    """Points that each scored indicator adds to the baseline."""
    from pyspark.sql import Window

    total = F.sum(F.when(F.col("risk_score").isNotNull(), F.col("weight"))).over(Window.partitionBy("company_id"))
    return indicators.select("company_id", "indicator_id", half_up_eps(F.try_divide(F.col("weight") * F.col("risk_score"), total), 4).alias("contribution"))


def review_status(base: DataFrame, dims: DataFrame) -> DataFrame:
    empty = dims.groupBy("company_id").agg(F.count_if(F.col("score").isNull()).alias("empty_dimensions"))
    status = (
        F.when(F.col("baseline_score").isNull(), "insufficient-data")
        .when((F.col("evidence_coverage") >= REVIEW_COVERAGE) & (F.col("empty_dimensions") == 0), "ready")
        .otherwise("manual-review")
    )
    return base.join(empty, "company_id").withColumn("review_status", status)


def propagation(paths: DataFrame) -> DataFrame:
    """Coefficient of each path, the product over its edges in order, and the risk it carries.

    paths: path_id, event_risk_score, edges (array of strength, time_decay, business_relevance).
    """
    one = F.aggregate("edges", F.lit(1.0), lambda a, e: a * e["strength"] * e["time_decay"] * e["business_relevance"])
    out = paths.withColumn("coefficient", half_up_eps(one, 6))
    return out.select(
        "path_id", "coefficient", half_up_eps(F.col("event_risk_score") * F.col("coefficient"), 4).alias("candidate_risk"),
        (F.col("coefficient") >= LEAST_COEFFICIENT).alias("included"),
    )


def red_flags(events: DataFrame) -> DataFrame:
    """Flagged events with their priority; they never change a baseline."""
    priority = F.when(F.col("severity").isin("critical", "high"), "P0").otherwise("P1")
    return events.where("red_flag").withColumn("priority", priority)


def scenarios(dims: DataFrame, presets: DataFrame, base: DataFrame) -> DataFrame:
    """Score of every preset from the dimensions that have one, and its gap to the baseline."""
    joined = dims.where("score is not null").join(F.broadcast(presets), "dimension_id")
    by = joined.groupBy("company_id", "preset_id").agg(
        F.try_divide(F.sum(F.col("preset_weight") * F.col("score")), F.sum("preset_weight")).alias("s")
    )
    scored = by.join(base.select("company_id", "baseline_score"), "company_id")
    return scored.select("company_id", "preset_id", half_up_eps(F.col("s"), 4).alias("scenario_score"), half_up_eps(F.col("s") - F.col("baseline_score"), 4).alias("delta"))


def tasks(flags: DataFrame, day: Column) -> DataFrame:
    """One task per red flag: owner by the indicator's first letter, due in 7 or 14 days."""
    letter = F.substring("indicator_id", 1, 1)
    owner = F.when(letter == "T", "technology").when(letter == "C", "compliance").when(letter == "F", "finance").when(letter == "E", "external").otherwise("governance")
    days = F.when(F.col("priority") == "P0", 7).otherwise(14)
    return flags.select("event_id", "priority", owner.alias("owner"), F.date_format(F.date_add(day, days), "yyyy-MM-dd").alias("due"))


def request_errors(indicators: DataFrame, evidence: DataFrame, weights: DataFrame) -> DataFrame:
    """(company_id, rule, entity) for everything a scoring request gets wrong; empty if it is sound.

    All rules are checked, none stops the others.
    """
    known = indicators.join(F.broadcast(weights.select("indicator_id", F.col("weight").alias("w"), F.col("dimension_id").alias("d"))), "indicator_id", "left")
    i = F.col("indicator_id")
    rules = [
        ("unknown-indicator", F.col("w").isNull()),
        ("wrong-weight", F.col("w").isNotNull() & ~F.col("weight").eqNullSafe(F.col("w"))),
        ("wrong-dimension", F.col("d").isNotNull() & ~F.col("dimension_id").eqNullSafe(F.col("d"))),
        ("unknown-status", ~F.coalesce(F.col("data_status").isin(STATUSES), F.lit(False))),
        ("score-out-of-range", F.col("risk_score").isNotNull() & ~F.col("risk_score").between(0, 100)),
        ("missing-has-score", (F.col("data_status") == "missing") & F.col("risk_score").isNotNull()),
        ("scored-without-score", (F.col("data_status") != "missing") & F.col("risk_score").isNull()),
        ("coverage-out-of-range", ~F.coalesce(F.col("coverage_factor").between(0, 1), F.lit(False))),
        ("confidence-out-of-range", ~F.coalesce(F.col("evidence_confidence").between(0, 1), F.lit(False))),
    ]
    found = known.select("company_id", F.explode(F.array_compact(F.array(*(F.when(test, F.struct(F.lit(r).alias("rule"), i.alias("entity"))) for r, test in rules)))).alias("e"))
    found = found.select("company_id", "e.rule", "e.entity")
    twice = indicators.groupBy("company_id", "indicator_id").count().where("count > 1").select("company_id", F.lit("duplicate-indicator").alias("rule"), i.alias("entity"))
    asked = indicators.select("company_id").distinct().join(F.broadcast(weights.select("indicator_id")), F.lit(True))
    absent = asked.join(indicators.select("company_id", "indicator_id"), ["company_id", "indicator_id"], "left_anti")
    absent = absent.select("company_id", F.lit("absent-indicator").alias("rule"), i.alias("entity"))
    bad = evidence.select("company_id", F.explode(F.array_compact(F.array(
        F.when(F.length(F.trim(F.coalesce("evidence_id", F.lit("")))) == 0, F.lit("evidence-without-id")),
        F.when(~F.coalesce(F.col("strength").isin(STRENGTHS), F.lit(False)), F.lit("unknown-strength")),
        F.when(~F.coalesce(http_url(F.col("url")), F.lit(False)), F.lit("unsafe-url")),
    ))).alias("rule"), F.coalesce("evidence_id", F.lit("")).alias("entity"))
    return found.unionByName(twice).unionByName(absent).unionByName(bad)
