from pyspark.sql import functions as F

from veldt.operators.assessment_rules import assessment_violations
from veldt.plans import catalogue as C

SCHEMAS = {
    "companies": "id string",
    "indicators": "id string, kind string, dimension_id string, weight int, affects_score boolean",
    "observations": "id string, company_id string, indicator_id string, snapshot_id string, status string, raw_value string, normalized_risk_score double, confidence double, review_status string",
    "evidence": "id string, company_id string, confidence double, api_call_log_id string",
    "bindings": "id string, company_id string, evidence_id string, target_type string, target_id string, support_strength string, inference_basis string",
    "events": "id string, company_id string, red_flag boolean",
    "event_dimensions": "event_id string, dimension_id string",
    "nodes": "id string, company_id string",
    "relations": "id string, company_id string, snapshot_id string, source_node_id string, target_node_id string, classification string, strength double, confidence double, base_impact double, time_decay double, relevance_decay double",
    "snapshots": "id string, company_id string, method_version string, baseline_score double, risk_level string, evidence_coverage double, confidence double",
    "snapshot_dimensions": "snapshot_id string, dimension_id string, score double, covered_weight double, total_weight int, coverage double, confidence double",
    "snapshot_observations": "snapshot_id string, observation_id string",
    "snapshot_missing": "snapshot_id string, indicator_id string",
    "snapshot_flags": "snapshot_id string, event_id string",
    "tasks": "id string, company_id string, snapshot_id string, source_type string, source_id string",
    "api_logs": "id string, company_id string, snapshot_id string, cost double",
}


def sound():
    scored = [i for i, _, _ in C.FIXED_WEIGHTS]
    return {
        "companies": [("c",), ("other",)],
        "indicators": [(i, "weighted", d, w, True) for i, d, w in C.FIXED_WEIGHTS] + [(n, "narrative-validation", None, None, False) for n in ("N01", "N02", "N03", "N04")],
        "observations": [(f"o-{i}", "c", i, "s", "available", "1", 10.0, 0.9, "reviewed") for i in scored],
        "evidence": [("e", "c", 0.9, "l")],
        "bindings": [(f"b-{i}", "c", "e", "observation", f"o-{i}", "direct", None) for i in scored],
        "events": [("v", "c", True)],
        "event_dimensions": [("v", "finance")],
        "nodes": [("n1", "c"), ("n2", "c")],
        "relations": [("r", "c", "s", "n1", "n2", "fact", 1.0, 1.0, None, None, None)],
        "snapshots": [("s", "c", C.FIXED_METHOD_VERSION, 10.0, "low", 1.0, 0.9)],
        "snapshot_dimensions": [("s", d, 10.0, float(w), w, 1.0, 0.9) for d, w in C.FIXED_DIMENSIONS],
        "snapshot_observations": [("s", f"o-{i}") for i in scored],
        "snapshot_missing": [],
        "snapshot_flags": [("s", "v")],
        "tasks": [("t", "c", "s", "event", "v")],
        "api_logs": [("l", "c", "s", 1.5)],
    }


def found(spark, data):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    tables = {k: spark.createDataFrame(data[k], s) for k, s in SCHEMAS.items()}
    return {(r.rule, r.entity) for r in assessment_violations(tables, C.fixed_weights(spark), C.fixed_dimensions(spark)).collect()}


def test_sound_dataset_has_no_violation(spark):
    assert found(spark, sound()) == set()


def test_seeded_violations_are_named(spark):
    d = sound()
    d["indicators"] = [("T01", "weighted", "technology", 5, True) if r[0] == "T01" else r for r in d["indicators"] if r[0] != "N04"]
    d["observations"] = [(*r[:6], 101.0, 2.0, "unreviewed") if r[0] == "o-T02" else r for r in d["observations"]] + [("o-x", "other", "T03", None, "missing", "1", None, 0.5, "reviewed")]
    d["bindings"] = [r for r in d["bindings"] if r[0] != "b-T03"] + [("b-x", "other", "e", "event", "gone", "inferred", " ")]
    d["events"] = [("v", "c", False)]
    d["relations"] = [("r", "other", "s", "n1", "n9", "inference", 1.5, 1.0, None, None, None)]
    d["snapshots"] = [("s", "c", "old", 60.0, "low", 0.5, 0.9), ("s2", "", "old", None, None, 0.0, None)]
    d["snapshot_observations"] += [("s", "o-x"), ("s", "o-T01")]
    d["snapshot_missing"] = [("s", "T01")]
    d["tasks"] = [("", "c", "s", "event", "v"), ("t", "other", "s", "event", "v"), ("t", "c", "s", "event", "v")]
    d["api_logs"] = [("l", "c", "s", -1.0)]
    rules = {r for r, _ in found(spark, d)}
    assert rules == {
        "INDICATOR_WEIGHT_MISMATCH", "NARRATIVE_INDICATOR_SET_MISMATCH", "WEIGHT_TOTAL_MISMATCH", "DIMENSION_WEIGHT_MISMATCH", "SCORE_OUT_OF_RANGE", "CONFIDENCE_OUT_OF_RANGE",
        "SCORED_OBSERVATION_NOT_APPROVED", "MISSING_OBSERVATION_HAS_VALUE", "SCORED_OBSERVATION_WITHOUT_EVIDENCE", "CROSS_COMPANY_EVIDENCE_BINDING", "INFERENCE_BASIS_REQUIRED",
        "UNKNOWN_REFERENCE", "INVALID_RED_FLAG_REFERENCE", "CROSS_COMPANY_GRAPH_RELATION", "RELATION_RATIO_OUT_OF_RANGE", "CROSS_COMPANY_RELATION_SNAPSHOT", "INFERENCE_CANNOT_BE_CERTAIN",
        "SNAPSHOT_METHOD_VERSION_MISMATCH", "SNAPSHOT_SCORE_LEVEL_MISMATCH", "SNAPSHOT_COVERAGE_MISMATCH", "SNAPSHOT_DIMENSION_SET_MISMATCH", "CROSS_COMPANY_SNAPSHOT_OBSERVATION",
        "DUPLICATE_SNAPSHOT_OBSERVATION", "DIMENSION_COVERAGE_MISMATCH", "SNAPSHOT_MISSING_INDICATORS_MISMATCH", "INVALID_TASK_SNAPSHOT", "CROSS_COMPANY_TASK_SOURCE", "EMPTY_ID", "DUPLICATE_ID",
        "INVALID_API_COST",
    }
