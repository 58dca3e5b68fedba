"""Integrity rules of an assessment dataset, as one table of violations (rule, entity).

The dataset is a dict of long tables: companies(id), indicators(id, kind, dimension_id, weight,
affects_score), observations, evidence, bindings, events, event_dimensions(event_id, dimension_id),
nodes, relations, snapshots, snapshot_dimensions, snapshot_observations(snapshot_id, observation_id),
snapshot_missing(snapshot_id, indicator_id), snapshot_flags(snapshot_id, event_id), tasks, api_logs.
Rule names are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.numeric import risk_level
from veldt.operators import validate as R
from veldt.plans.catalogue import FIXED_METHOD_VERSION

TABLES = ["companies", "indicators", "observations", "evidence", "bindings", "events", "nodes", "relations", "snapshots", "tasks", "api_logs"]
NARRATIVE = ["N01", "N02", "N03", "N04"]
TOLERANCE = 1e-12


def _outside(c: Column, low: float, high: float) -> Column:
    return c.isNotNull() & (F.isnan(c) | ~c.between(low, high))


def _crossing(df: DataFrame, column: str, target: DataFrame, rule: str) -> DataFrame:
    """Rows that refer to a row of another company."""
    other = target.select(F.col("id").alias(column), F.col("company_id").alias("_other"))
    return R.check(df.join(other, column), F.col("company_id") != F.col("_other"), rule, "id")


def identity_rules(d: dict[str, DataFrame]) -> list[DataFrame]:
    out = []
    for name in TABLES:
        out += [R.not_empty(d[name], "id", "EMPTY_ID", "id"), R.unique(d[name], ["id"], "DUPLICATE_ID")]
    own = [t for t in TABLES if t not in ("companies", "indicators")]
    out += [R.references(d[t], "company_id", d["companies"], "id", "UNKNOWN_REFERENCE", "id") for t in own]
    for table, column, target in (
        ("observations", "indicator_id", "indicators"), ("observations", "snapshot_id", "snapshots"), ("evidence", "api_call_log_id", "api_logs"),
        ("bindings", "evidence_id", "evidence"), ("relations", "source_node_id", "nodes"), ("relations", "target_node_id", "nodes"),
        ("relations", "snapshot_id", "snapshots"), ("tasks", "snapshot_id", "snapshots"), ("api_logs", "snapshot_id", "snapshots"),
    ):
        out.append(R.references(d[table], column, d[target], "id", "UNKNOWN_REFERENCE", "id"))
    targets = {"observation": (d["observations"], "id"), "event": (d["events"], "id"), "relation": (d["relations"], "id"), "snapshot": (d["snapshots"], "id")}
    out.append(R.polymorphic(d["bindings"], targets, "UNKNOWN_REFERENCE", "id"))
    return out


def contract_rules(d: dict[str, DataFrame], weights: DataFrame, dimensions: DataFrame) -> list[DataFrame]:
    """Indicators against the fixed weights. weights: indicator_id, dimension_id, weight."""
    i = d["indicators"]
    scored, narrative = i.where("kind = 'weighted'"), i.where("kind = 'narrative-validation'")
    w = weights.select(F.col("indicator_id").alias("id"), F.col("weight").alias("_w"))
    known = scored.join(F.broadcast(w), "id", "left")
    expected = weights.select(F.col("indicator_id").alias("id"))
    by = scored.groupBy("dimension_id").agg(F.sum("weight").alias("sum")).join(F.broadcast(dimensions), "dimension_id", "full")
    wrong = F.abs(F.coalesce(F.col("sum"), F.lit(0)) - F.coalesce(F.col("dimension_weight"), F.lit(0))) > TOLERANCE
    total = scored.agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("sum")).select(F.lit("indicators").alias("id"), "sum")
    names = narrative.sparkSession.createDataFrame([(n,) for n in NARRATIVE], "id string")
    sets = lambda a, b, rule: R.set_equal(a, b, "id", rule).select(F.lit(rule).alias("rule"), "entity")
    return [
        R.check(known, F.col("_w").isNull(), "UNKNOWN_WEIGHTED_INDICATOR", "id"),
        R.check(scored, ~F.coalesce(F.col("weight") > 0, F.lit(False)), "INVALID_WEIGHT", "id"),
        R.check(known, F.col("_w").isNotNull() & ~F.col("weight").eqNullSafe(F.col("_w")), "INDICATOR_WEIGHT_MISMATCH", "id"),
        R.check(narrative, ~F.col("id").isin(NARRATIVE), "UNKNOWN_NARRATIVE_INDICATOR", "id"),
        R.check(narrative, F.col("affects_score") | F.col("weight").isNotNull() | F.col("dimension_id").isNotNull(), "NARRATIVE_AFFECTS_SCORE", "id"),
        sets(expected, scored, "WEIGHTED_INDICATOR_SET_MISMATCH"),
        sets(names, narrative, "NARRATIVE_INDICATOR_SET_MISMATCH"),
        R.check(total, F.abs(F.col("sum") - 100) > TOLERANCE, "WEIGHT_TOTAL_MISMATCH", "id"),
        R.check(by, wrong, "DIMENSION_WEIGHT_MISMATCH", "dimension_id"),
    ]


def observation_rules(d: dict[str, DataFrame]) -> list[DataFrame]:
    o = d["observations"].join(F.broadcast(d["indicators"].select(F.col("id").alias("indicator_id"), "kind")), "indicator_id", "left")
    score = F.col("normalized_risk_score")
    bound = d["bindings"].where("target_type = 'observation'").where(
        (F.col("support_strength") == "direct") | ((F.col("support_strength") == "inferred") & (F.length(F.trim(F.coalesce("inference_basis", F.lit("")))) > 0))
    )
    bare = o.where(score.isNotNull()).join(bound.select(F.col("target_id").alias("id")).distinct(), "id", "left_anti")
    return [
        _crossing(d["observations"], "snapshot_id", d["snapshots"], "CROSS_COMPANY_OBSERVATION_SNAPSHOT"),
        R.check(o, _outside(score, 0, 100), "SCORE_OUT_OF_RANGE", "id"),
        R.check(o, _outside(F.col("confidence"), 0, 1), "CONFIDENCE_OUT_OF_RANGE", "id"),
        R.check(d["evidence"], _outside(F.col("confidence"), 0, 1), "CONFIDENCE_OUT_OF_RANGE", "id"),
        R.check(o, (F.col("status") == "missing") & (F.col("raw_value").isNotNull() | score.isNotNull()), "MISSING_OBSERVATION_HAS_VALUE", "id"),
        R.check(o, (F.col("kind") == "narrative-validation") & score.isNotNull(), "NARRATIVE_OBSERVATION_SCORED", "id"),
        R.check(o, score.isNotNull() & ((F.col("status") != "available") | (F.col("review_status") != "reviewed")), "SCORED_OBSERVATION_NOT_APPROVED", "id"),
        R._violation(bare, "SCORED_OBSERVATION_WITHOUT_EVIDENCE", F.col("id")),
        _crossing(d["evidence"], "api_call_log_id", d["api_logs"], "CROSS_COMPANY_EVIDENCE_API_LOG"),
        _crossing(d["bindings"], "evidence_id", d["evidence"], "CROSS_COMPANY_EVIDENCE_BINDING"),
        R.check(d["bindings"], (F.col("support_strength") == "inferred") & (F.length(F.trim(F.coalesce("inference_basis", F.lit("")))) == 0), "INFERENCE_BASIS_REQUIRED", "id"),
        R.unique(d["event_dimensions"], ["event_id", "dimension_id"], "DUPLICATE_DIMENSION_REFERENCE"),
    ]


def relation_rules(d: dict[str, DataFrame]) -> list[DataFrame]:
    r = d["relations"]
    ratios = ["strength", "confidence", "base_impact", "time_decay", "relevance_decay"]
    bad = F.exists(F.array(*ratios), lambda x: x.isNotNull() & (F.isnan(x) | ~x.between(0, 1)))
    return [
        _crossing(r, "source_node_id", d["nodes"], "CROSS_COMPANY_GRAPH_RELATION"),
        _crossing(r, "target_node_id", d["nodes"], "CROSS_COMPANY_GRAPH_RELATION"),
        R.check(r, bad, "RELATION_RATIO_OUT_OF_RANGE", "id"),
        _crossing(r, "snapshot_id", d["snapshots"], "CROSS_COMPANY_RELATION_SNAPSHOT"),
        R.check(r, (F.col("classification") == "inference") & (F.col("confidence") >= 1), "INFERENCE_CANNOT_BE_CERTAIN", "id"),
    ]


def snapshot_rules(d: dict[str, DataFrame], weights: DataFrame, dimensions: DataFrame) -> list[DataFrame]:
    s, dims, obs = d["snapshots"], d["snapshot_dimensions"], d["snapshot_observations"]
    numbers = _outside(F.col("baseline_score"), 0, 100) | _outside(F.col("evidence_coverage"), 0, 1) | _outside(F.col("confidence"), 0, 1)
    used = obs.join(d["observations"].select(F.col("id").alias("observation_id"), F.col("company_id").alias("_oc"), "indicator_id", "normalized_risk_score"), "observation_id")
    crossing = used.join(s.select(F.col("id").alias("snapshot_id"), "company_id"), "snapshot_id").where("company_id <> _oc")
    scored = used.where("normalized_risk_score is not null").join(F.broadcast(weights), "indicator_id")
    per_dim = scored.groupBy("snapshot_id", "dimension_id").agg(F.sum("weight").alias("_covered"))
    checked = dims.join(F.broadcast(dimensions), "dimension_id", "left").join(per_dim, ["snapshot_id", "dimension_id"], "left")
    covered = F.coalesce("_covered", F.lit(0))
    name = F.concat_ws("|", "snapshot_id", "dimension_id")
    invalid = _outside(F.col("score"), 0, 100) | _outside(F.col("confidence"), 0, 1) | _outside(F.col("coverage"), 0, 1) | ~F.col("total_weight").eqNullSafe(F.col("dimension_weight"))
    wrong = (F.abs(F.col("covered_weight") - covered) > TOLERANCE) | (F.abs(F.col("coverage") - F.try_divide(covered, F.col("dimension_weight"))) > TOLERANCE)
    whole = s.join(scored.groupBy(F.col("snapshot_id").alias("id")).agg((F.sum("weight") / 100.0).alias("_c")), "id", "left")
    expected = s.select(F.col("id").alias("snapshot_id")).join(F.broadcast(weights.select("indicator_id")), F.lit(True)).join(
        scored.select("snapshot_id", "indicator_id"), ["snapshot_id", "indicator_id"], "left_anti"
    )
    missing = d["snapshot_missing"]
    pair = F.concat_ws("|", "snapshot_id", "indicator_id")
    flags = d["snapshot_flags"].join(d["events"].select(F.col("id").alias("event_id"), F.col("company_id").alias("_ec"), "red_flag"), "event_id", "left").join(
        s.select(F.col("id").alias("snapshot_id"), "company_id"), "snapshot_id"
    )
    bad_flag = F.col("_ec").isNull() | (F.col("_ec") != F.col("company_id")) | ~F.col("red_flag")
    every = s.select(F.col("id").alias("snapshot_id")).join(F.broadcast(dimensions.select("dimension_id")), F.lit(True))
    absent = every.join(dims.select("snapshot_id", "dimension_id"), ["snapshot_id", "dimension_id"], "left_anti")
    return [
        R.check(s, F.col("method_version") != FIXED_METHOD_VERSION, "SNAPSHOT_METHOD_VERSION_MISMATCH", "id"),
        R.check(s, numbers, "SNAPSHOT_METRIC_OUT_OF_RANGE", "id"),
        R.check(s, ~F.col("risk_level").eqNullSafe(risk_level(F.col("baseline_score"))), "SNAPSHOT_SCORE_LEVEL_MISMATCH", "id"),
        R._violation(absent, "SNAPSHOT_DIMENSION_SET_MISMATCH", name),
        R.unique(dims, ["snapshot_id", "dimension_id"], "SNAPSHOT_DIMENSION_SET_MISMATCH"),
        R.unique(obs, ["snapshot_id", "observation_id"], "DUPLICATE_SNAPSHOT_OBSERVATION"),
        R._violation(checked.where(F.coalesce(invalid, F.lit(False))), "DIMENSION_METRIC_INVALID", name),
        R._violation(checked.where(F.coalesce(wrong, F.lit(True))), "DIMENSION_COVERAGE_MISMATCH", name),
        R.check(whole, F.abs(F.col("evidence_coverage") - F.coalesce("_c", F.lit(0.0))) > TOLERANCE, "SNAPSHOT_COVERAGE_MISMATCH", "id"),
        R._violation(crossing, "CROSS_COMPANY_SNAPSHOT_OBSERVATION", F.concat_ws("|", "snapshot_id", "observation_id")),
        R._violation(flags.where(F.coalesce(bad_flag, F.lit(True))), "INVALID_RED_FLAG_REFERENCE", F.concat_ws("|", "snapshot_id", "event_id")),
        R._violation(expected.join(missing, ["snapshot_id", "indicator_id"], "left_anti"), "SNAPSHOT_MISSING_INDICATORS_MISMATCH", pair),
        R._violation(missing.join(expected, ["snapshot_id", "indicator_id"], "left_anti"), "SNAPSHOT_MISSING_INDICATORS_MISMATCH", pair),
    ]


def task_rules(d: dict[str, DataFrame]) -> list[DataFrame]:
    t = d["tasks"]
    sources = {"event": d["events"], "relation": d["relations"]}
    crossing = [_crossing(t.where(F.col("source_type") == k).withColumn("source_id", F.col("source_id")), "source_id", v, "CROSS_COMPANY_TASK_SOURCE") for k, v in sources.items()]
    return [
        _crossing(t, "snapshot_id", d["snapshots"], "INVALID_TASK_SNAPSHOT"),
        *crossing,
        _crossing(d["api_logs"], "snapshot_id", d["snapshots"], "CROSS_COMPANY_API_LOG_SNAPSHOT"),
        R.check(d["api_logs"], F.col("cost").isNotNull() & (F.isnan("cost") | (F.col("cost") < 0)), "INVALID_API_COST", "id"),
    ]


def assessment_violations(d: dict[str, DataFrame], weights: DataFrame, dimensions: DataFrame) -> DataFrame:
    """All violations of all rules; a sound dataset gives an empty table."""
    return R.all_of(*identity_rules(d), *contract_rules(d, weights, dimensions), *observation_rules(d), *relation_rules(d), *snapshot_rules(d, weights, dimensions), *task_rules(d))
