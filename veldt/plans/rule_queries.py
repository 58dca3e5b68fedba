"""Queries of the rules of requests and of assessment datasets, on mistakes planted in tables derived from the suppliers.

Each derived table is a list of expressions that both engines read; the rules are written for each engine on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.operators import fixedweight as W
from veldt.operators.assessment_rules import NARRATIVE, TABLES, assessment_violations
from veldt.plans import catalogue as C
from veldt.registry import query
from veldt.sources import adapter as A

_N = len(C.FIXED_WEIGHTS)
_WEIGHTS = [(j, i, d, w) for j, (i, d, w) in enumerate(C.FIXED_WEIGHTS)]
# Sources of the derived tables: suppliers by key k; times the weighted indicators; times the dimensions; twice each.
_FROM = {
    "k": "SELECT s_suppkey AS k, concat('c', s_suppkey) AS c FROM supplier",
    "ki": f"SELECT s_suppkey AS k, concat('c', s_suppkey) AS c, s_suppkey * {_N} + j AS x, i, d, w FROM supplier CROSS JOIN (VALUES {C.as_values(_WEIGHTS)}) AS t(j, i, d, w)",
    "kd": f"SELECT s_suppkey AS k, concat('c', s_suppkey) AS c, s_suppkey * 5 + j AS x, d, w FROM supplier CROSS JOIN (VALUES {C.as_values([(j, d, w) for j, (d, w) in enumerate(C.FIXED_DIMENSIONS)])}) AS t(j, d, w)",
    "kk": "SELECT s_suppkey AS k, concat('c', s_suppkey) AS c, j FROM supplier CROSS JOIN (VALUES (0), (1)) AS t(j)",
}


def _select(source: str, columns: dict[str, str], where: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM ({_FROM[source]}) q WHERE {where}"


def _derived(spark, folder, tables: dict[str, tuple[str, dict[str, str], str]]) -> dict[str, DataFrame]:
    supplier = A.table(spark, folder, "supplier").select("s_suppkey")
    return {name: spark.sql(_select(*t).replace("FROM supplier", "FROM {supplier}"), supplier=supplier) for name, t in tables.items()}


def _ctes(tables: dict[str, tuple[str, dict[str, str], str]]) -> str:
    return ", ".join(f"{name} AS ({_select(*t)})" for name, t in tables.items())


def _double(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


# ---- rules on the indicators of a request

_REQUEST = {
    "given": ("ki", {
        "company_id": "c", "indicator_id": "CASE WHEN x % 23 = 0 THEN 'T99' ELSE i END", "weight": "CASE WHEN x % 19 = 0 THEN w + 1 ELSE w END", "dimension_id": "CASE WHEN x % 17 = 0 THEN 'other' ELSE d END",
        "data_status": "CASE WHEN x % 13 = 0 THEN 'odd' WHEN x % 13 = 1 THEN 'missing' WHEN x % 13 = 2 THEN 'partial' ELSE 'complete' END",
        "risk_score": _double("CASE WHEN x % 11 = 0 THEN 101 WHEN x % 11 = 1 THEN NULL ELSE x % 100 END"), "coverage_factor": _double("CASE WHEN x % 29 = 0 THEN NULL WHEN x % 29 = 1 THEN 2 ELSE 1 END"),
        "evidence_confidence": _double("CASE WHEN x % 37 = 0 THEN -1 ELSE 1 END"),
    }, "x % 101 <> 7"),
    "proof": ("k", {"company_id": "c", "evidence_id": "CASE WHEN k % 7 = 0 THEN ' ' ELSE concat('e', k) END", "strength": "CASE WHEN k % 5 = 0 THEN 'odd' ELSE 'direct' END", "url": "CASE WHEN k % 6 = 0 THEN 'ftp://x' WHEN k % 6 = 1 THEN NULL ELSE 'https://e.example/' END"}, "k % 8 <> 1"),
}


@query(f"""WITH {_ctes(_REQUEST)}, weights(j, indicator_id, d, w) AS (VALUES {C.as_values(_WEIGHTS)}), known AS (SELECT given.*, d, w FROM given LEFT JOIN weights USING (indicator_id))
SELECT company_id, 'unknown-indicator' AS rule, indicator_id AS entity FROM known WHERE w IS NULL
UNION ALL SELECT company_id, 'wrong-weight', indicator_id FROM known WHERE w <> weight UNION ALL SELECT company_id, 'wrong-dimension', indicator_id FROM known WHERE d <> dimension_id
UNION ALL SELECT company_id, 'unknown-status', indicator_id FROM known WHERE data_status = 'odd' UNION ALL SELECT company_id, 'score-out-of-range', indicator_id FROM known WHERE risk_score > 100
UNION ALL SELECT company_id, 'missing-has-score', indicator_id FROM known WHERE data_status = 'missing' AND risk_score IS NOT NULL UNION ALL SELECT company_id, 'scored-without-score', indicator_id FROM known WHERE data_status <> 'missing' AND risk_score IS NULL
UNION ALL SELECT company_id, 'coverage-out-of-range', indicator_id FROM known WHERE coverage_factor IS NULL OR coverage_factor > 1 UNION ALL SELECT company_id, 'confidence-out-of-range', indicator_id FROM known WHERE evidence_confidence < 0
UNION ALL SELECT company_id, 'duplicate-indicator', indicator_id FROM given GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT company_id, 'absent-indicator', indicator_id FROM (SELECT company_id, weights.indicator_id FROM (SELECT DISTINCT company_id FROM given) CROSS JOIN weights EXCEPT SELECT company_id, indicator_id FROM given)
UNION ALL SELECT company_id, 'evidence-without-id', evidence_id FROM proof WHERE trim(evidence_id) = '' UNION ALL SELECT company_id, 'unknown-strength', evidence_id FROM proof WHERE strength = 'odd' UNION ALL SELECT company_id, 'unsafe-url', evidence_id FROM proof WHERE url LIKE 'ftp%'""")
def indicator_request_violations(spark, folder):
    d = _derived(spark, folder, _REQUEST)
    return W.request_errors(d["given"], d["proof"], C.fixed_weights(spark))


# ---- rules of an assessment dataset

_X = "concat('o-', k, '-', i)"
_ASSESSMENT = {
    "companies": ("k", {"id": "CASE WHEN k % 40 = 9 THEN concat('c', k - 1) ELSE c END"}, "true"),
    "observations": ("ki", {
        "id": _X, "company_id": "CASE WHEN x % 97 = 0 THEN concat('c', k + 1) ELSE c END", "indicator_id": "CASE WHEN x % 89 = 1 THEN 'N01' ELSE i END", "snapshot_id": "concat('s', k)", "status": "CASE WHEN x % 41 = 0 THEN 'missing' ELSE 'available' END", "raw_value": "'1'",
        "normalized_risk_score": _double("CASE WHEN x % 43 = 0 THEN 101 WHEN x % 83 = 2 THEN NULL ELSE 10 END"), "confidence": _double("CASE WHEN x % 47 = 0 THEN 2 ELSE 1 END"), "review_status": "CASE WHEN x % 53 = 0 THEN 'open' ELSE 'reviewed' END",
    }, "true"),
    "evidence": ("k", {"id": "concat('e', k)", "company_id": "c", "confidence": _double("CASE WHEN k % 21 = 0 THEN -1 ELSE 1 END"), "api_call_log_id": "CASE WHEN k % 22 = 1 THEN 'l-none' WHEN k % 22 = 2 THEN concat('l', k + 1) ELSE concat('l', k) END"}, "true"),
    "bindings": ("ki", {
        "id": "concat('b-', k, '-', i)", "company_id": "c", "evidence_id": "CASE WHEN x % 59 = 0 THEN concat('e', k + 1) ELSE concat('e', k) END", "target_type": "'observation'", "target_id": f"CASE WHEN x % 61 = 0 THEN 'gone' ELSE {_X} END",
        "support_strength": "CASE WHEN x % 5 = 0 THEN 'inferred' ELSE 'direct' END", "inference_basis": "CASE WHEN x % 10 = 0 THEN ' ' ELSE 'why' END",
    }, "true"),
    "events": ("k", {"id": "concat('v', k)", "company_id": "c", "red_flag": "k % 9 <> 1"}, "true"),
    "event_dimensions": ("kk", {"event_id": "concat('v', k)", "dimension_id": "'finance'"}, "j = 0 OR k % 25 = 3"),
    "nodes": ("kk", {"id": "concat('n', k, '-', j)", "company_id": "CASE WHEN k % 31 = 4 AND j = 1 THEN concat('c', k + 1) ELSE c END"}, "true"),
    "relations": ("k", {
        "id": "concat('r', k)", "company_id": "c", "snapshot_id": "CASE WHEN k % 32 = 3 THEN concat('s', k + 1) ELSE concat('s', k) END", "source_node_id": "concat('n', k, '-0')", "target_node_id": "CASE WHEN k % 33 = 5 THEN 'none' ELSE concat('n', k, '-1') END", "classification": "CASE WHEN k % 2 = 0 THEN 'inference' ELSE 'fact' END",
        "strength": _double("CASE WHEN k % 34 = 6 THEN 2 ELSE 1 END"), "confidence": _double("CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END"), "base_impact": _double("NULL"), "time_decay": _double("1"), "relevance_decay": _double("NULL"),
    }, "true"),
    "snapshots": ("k", {
        "id": "concat('s', k)", "company_id": "c", "method_version": f"CASE WHEN k % 35 = 7 THEN 'old' ELSE '{C.FIXED_METHOD_VERSION}' END", "baseline_score": _double("CASE WHEN k % 36 = 8 THEN 60 ELSE 10 END"), "risk_level": "'low'",
        "evidence_coverage": _double("1"), "confidence": _double("CASE WHEN k % 38 = 9 THEN 2 ELSE 1 END"),
    }, "true"),
    "snapshot_dimensions": ("kd", {"snapshot_id": "concat('s', k)", "dimension_id": "d", "score": _double("CASE WHEN x % 39 = 0 THEN -1 ELSE 10 END"), "covered_weight": _double("w"), "total_weight": "w", "coverage": _double("1"), "confidence": _double("1")}, "x % 55 <> 1"),
    "snapshot_observations": ("ki", {"snapshot_id": "concat('s', k)", "observation_id": f"CASE WHEN x % 67 = 0 THEN concat('o-', k + 1, '-', i) WHEN x % 73 = 0 THEN concat('o-', k, '-T01') ELSE {_X} END"}, "true"),
    "snapshot_missing": ("ki", {"snapshot_id": "concat('s', k)", "indicator_id": "i"}, "x % 71 = 0"),
    "snapshot_flags": ("k", {"snapshot_id": "concat('s', k)", "event_id": "CASE WHEN k % 27 = 2 THEN 'v-none' ELSE concat('v', k) END"}, "true"),
    "tasks": ("k", {"id": "CASE WHEN k % 42 = 1 THEN ' ' ELSE concat('t', k) END", "company_id": "c", "snapshot_id": "CASE WHEN k % 44 = 2 THEN concat('s', k + 1) ELSE concat('s', k) END", "source_type": "'event'", "source_id": "CASE WHEN k % 46 = 3 THEN concat('v', k + 1) ELSE concat('v', k) END"}, "true"),
    "api_logs": ("k", {"id": "concat('l', k)", "company_id": "c", "snapshot_id": "CASE WHEN k % 48 = 4 THEN concat('s', k + 1) ELSE concat('s', k) END", "cost": _double("CASE WHEN k % 45 = 3 THEN -1 ELSE 1 END")}, "true"),
}
_INDICATORS = [(i, "weighted", d, w + (i == "T01"), True) for i, d, w in C.FIXED_WEIGHTS] + [("Z01", "weighted", "technology", 0, True)] + [(n, "narrative-validation", None, None, n == "N01") for n in ("N01", "N02", "N03", "N09")]


def _outside(c: str, low: int, high: int) -> str:
    return f"(isnan({c}) OR {c} NOT BETWEEN {low} AND {high})"


def _assessment_sql() -> str:
    parts = [(t, "EMPTY_ID", "coalesce(id, '')", "trim(coalesce(id, '')) = ''") for t in TABLES]
    parts += [(f"(SELECT id FROM {t} GROUP BY 1 HAVING count(*) > 1)", "DUPLICATE_ID", "id", "true") for t in TABLES]
    refs = [(t, "company_id", "companies") for t in TABLES if t not in ("companies", "indicators")]
    refs += [("observations", "indicator_id", "indicators"), ("observations", "snapshot_id", "snapshots"), ("evidence", "api_call_log_id", "api_logs"), ("bindings", "evidence_id", "evidence"), ("bindings", "target_id", "observations"),
             ("relations", "source_node_id", "nodes"), ("relations", "target_node_id", "nodes"), ("relations", "snapshot_id", "snapshots"), ("tasks", "snapshot_id", "snapshots"), ("api_logs", "snapshot_id", "snapshots")]
    parts += [(t, "UNKNOWN_REFERENCE", "id", f"{c} NOT IN (SELECT id FROM {target})") for t, c, target in refs]
    cross = [("observations", "snapshot_id", "snapshots", "OBSERVATION_SNAPSHOT"), ("evidence", "api_call_log_id", "api_logs", "EVIDENCE_API_LOG"), ("bindings", "evidence_id", "evidence", "EVIDENCE_BINDING"),
             ("relations", "source_node_id", "nodes", "GRAPH_RELATION"), ("relations", "target_node_id", "nodes", "GRAPH_RELATION"), ("relations", "snapshot_id", "snapshots", "RELATION_SNAPSHOT"), ("tasks", "source_id", "events", "TASK_SOURCE"), ("api_logs", "snapshot_id", "snapshots", "API_LOG_SNAPSHOT")]
    parts += [(f"{t} a JOIN {target} b ON a.{c} = b.id", f"CROSS_COMPANY_{rule}", "a.id", "a.company_id <> b.company_id") for t, c, target, rule in cross]
    narrative = ", ".join(f"'{n}'" for n in NARRATIVE)
    parts += [
        ("tasks a JOIN snapshots b ON a.snapshot_id = b.id", "INVALID_TASK_SNAPSHOT", "a.id", "a.company_id <> b.company_id"),
        ("indicators", "UNKNOWN_WEIGHTED_INDICATOR", "id", "kind = 'weighted' AND id NOT IN (SELECT i FROM weights)"), ("indicators", "INVALID_WEIGHT", "id", "kind = 'weighted' AND weight <= 0"),
        ("indicators JOIN weights ON id = i", "INDICATOR_WEIGHT_MISMATCH", "id", "weight <> w"), ("indicators", "UNKNOWN_NARRATIVE_INDICATOR", "id", f"kind <> 'weighted' AND id NOT IN ({narrative})"),
        ("indicators", "NARRATIVE_AFFECTS_SCORE", "id", "kind <> 'weighted' AND affects_score"),
        ("weights", "WEIGHTED_INDICATOR_SET_MISMATCH", "i", "i NOT IN (SELECT id FROM indicators)"), ("indicators", "WEIGHTED_INDICATOR_SET_MISMATCH", "id", "kind = 'weighted' AND id NOT IN (SELECT i FROM weights)"),
        (f"(SELECT unnest([{narrative}]) AS n)", "NARRATIVE_INDICATOR_SET_MISMATCH", "n", "n NOT IN (SELECT id FROM indicators)"), ("indicators", "NARRATIVE_INDICATOR_SET_MISMATCH", "id", f"kind <> 'weighted' AND id NOT IN ({narrative})"),
        ("(SELECT sum(weight) AS t FROM indicators)", "WEIGHT_TOTAL_MISMATCH", "'indicators'", "t <> 100"),
        ("(SELECT dimension_id, sum(weight) AS t FROM indicators WHERE kind = 'weighted' GROUP BY 1) JOIN dims ON dimension_id = dd", "DIMENSION_WEIGHT_MISMATCH", "dimension_id", "t <> dw"),
        ("observations", "SCORE_OUT_OF_RANGE", "id", _outside("normalized_risk_score", 0, 100)), ("observations", "CONFIDENCE_OUT_OF_RANGE", "id", _outside("confidence", 0, 1)), ("evidence", "CONFIDENCE_OUT_OF_RANGE", "id", _outside("confidence", 0, 1)),
        ("observations", "MISSING_OBSERVATION_HAS_VALUE", "id", "status = 'missing' AND (raw_value IS NOT NULL OR normalized_risk_score IS NOT NULL)"),
        ("observations", "NARRATIVE_OBSERVATION_SCORED", "id", "indicator_id LIKE 'N%' AND normalized_risk_score IS NOT NULL"),
        ("observations", "SCORED_OBSERVATION_NOT_APPROVED", "id", "normalized_risk_score IS NOT NULL AND (status <> 'available' OR review_status <> 'reviewed')"),
        ("observations", "SCORED_OBSERVATION_WITHOUT_EVIDENCE", "id", "normalized_risk_score IS NOT NULL AND id NOT IN (SELECT target_id FROM bindings WHERE support_strength = 'direct' OR trim(inference_basis) <> '')"),
        ("bindings", "INFERENCE_BASIS_REQUIRED", "id", "support_strength = 'inferred' AND trim(inference_basis) = ''"),
        ("(SELECT event_id, dimension_id FROM event_dimensions GROUP BY 1, 2 HAVING count(*) > 1)", "DUPLICATE_DIMENSION_REFERENCE", "event_id || '|' || dimension_id", "true"),
        ("relations", "RELATION_RATIO_OUT_OF_RANGE", "id", " OR ".join(f"coalesce({_outside(c, 0, 1)}, false)" for c in ("strength", "confidence", "base_impact", "time_decay", "relevance_decay"))),
        ("relations", "INFERENCE_CANNOT_BE_CERTAIN", "id", "classification = 'inference' AND confidence >= 1"),
        ("snapshots", "SNAPSHOT_METHOD_VERSION_MISMATCH", "id", f"method_version <> '{C.FIXED_METHOD_VERSION}'"),
        ("snapshots", "SNAPSHOT_METRIC_OUT_OF_RANGE", "id", f"{_outside('baseline_score', 0, 100)} OR {_outside('evidence_coverage', 0, 1)} OR {_outside('confidence', 0, 1)}"),
        ("snapshots", "SNAPSHOT_SCORE_LEVEL_MISMATCH", "id", "risk_level <> CASE WHEN baseline_score < 25 THEN 'low' WHEN baseline_score < 50 THEN 'medium' WHEN baseline_score < 75 THEN 'high' ELSE 'critical' END"),
        ("(SELECT id AS s, dd FROM snapshots CROSS JOIN dims EXCEPT SELECT snapshot_id, dimension_id FROM snapshot_dimensions)", "SNAPSHOT_DIMENSION_SET_MISMATCH", "s || '|' || dd", "true"),
        ("(SELECT snapshot_id, observation_id FROM snapshot_observations GROUP BY 1, 2 HAVING count(*) > 1)", "DUPLICATE_SNAPSHOT_OBSERVATION", "snapshot_id || '|' || observation_id", "true"),
        ("checked", "DIMENSION_METRIC_INVALID", "snapshot_id || '|' || dimension_id", f"{_outside('score', 0, 100)} OR {_outside('confidence', 0, 1)} OR {_outside('coverage', 0, 1)} OR total_weight <> dw"),
        ("checked", "DIMENSION_COVERAGE_MISMATCH", "snapshot_id || '|' || dimension_id", "covered_weight <> covered OR abs(coverage - covered / dw) > 1e-12"),
        ("snapshots LEFT JOIN (SELECT snapshot_id, sum(w) / CAST(100 AS DOUBLE) AS part FROM scored GROUP BY 1) p ON p.snapshot_id = id", "SNAPSHOT_COVERAGE_MISMATCH", "id", "abs(evidence_coverage - coalesce(part, 0)) > 1e-12"),
        ("used JOIN snapshots ON id = used.snapshot_id", "CROSS_COMPANY_SNAPSHOT_OBSERVATION", "used.snapshot_id || '|' || observation_id", "snapshots.company_id <> used.company_id"),
        ("snapshot_flags f JOIN snapshots s ON f.snapshot_id = s.id LEFT JOIN events e ON e.id = f.event_id", "INVALID_RED_FLAG_REFERENCE", "f.snapshot_id || '|' || f.event_id", "e.id IS NULL OR e.company_id <> s.company_id OR NOT red_flag"),
        ("(SELECT * FROM expected EXCEPT SELECT snapshot_id, indicator_id FROM snapshot_missing) e(s, i)", "SNAPSHOT_MISSING_INDICATORS_MISMATCH", "s || '|' || i", "true"),
        ("(SELECT snapshot_id, indicator_id FROM snapshot_missing EXCEPT SELECT * FROM expected) e(s, i)", "SNAPSHOT_MISSING_INDICATORS_MISMATCH", "s || '|' || i", "true"),
        ("api_logs", "INVALID_API_COST", "id", "cost < 0"),
    ]
    every = "\nUNION ALL ".join(f"SELECT '{rule}' AS rule, {entity} AS entity FROM {source} WHERE {where}" for source, rule, entity, where in parts)
    return f"""WITH {_ctes(_ASSESSMENT)}, weights(j, i, d, w) AS (VALUES {C.as_values(_WEIGHTS)}), dims(dd, dw) AS (VALUES {C.as_values(C.FIXED_DIMENSIONS)}), indicators(id, kind, dimension_id, weight, affects_score) AS (VALUES {C.as_values(_INDICATORS)}),
used AS (SELECT snapshot_id, observation_id, company_id, indicator_id, normalized_risk_score FROM snapshot_observations JOIN (SELECT id AS observation_id, company_id, indicator_id, normalized_risk_score FROM observations) USING (observation_id)),
scored AS (SELECT snapshot_id, i, d, w FROM used JOIN weights ON indicator_id = i WHERE normalized_risk_score IS NOT NULL),
checked AS (SELECT sd.*, dw, coalesce(covered, 0) AS covered FROM snapshot_dimensions sd JOIN dims ON dimension_id = dd LEFT JOIN (SELECT snapshot_id, d AS dimension_id, sum(w) AS covered FROM scored GROUP BY 1, 2) USING (snapshot_id, dimension_id)),
expected AS (SELECT id, i FROM snapshots CROSS JOIN weights EXCEPT SELECT snapshot_id, i FROM scored)
SELECT rule, entity, count(*) AS times FROM ({every}) GROUP BY 1, 2"""


@query(_assessment_sql())
def assessment_rule_violations(spark, folder):
    """Every rule and what breaks it, with how many of its references do."""
    d = _derived(spark, folder, _ASSESSMENT)
    d["indicators"] = spark.createDataFrame(_INDICATORS, "id string, kind string, dimension_id string, weight int, affects_score boolean")
    found = assessment_violations(d, C.fixed_weights(spark), C.fixed_dimensions(spark))
    return found.groupBy("rule", "entity").agg(F.count("*").alias("times"))
