"""Queries of the technology baseline: requests of companies, evidence from their events, metrics and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import baseline as B
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.plans.risk_queries import _HOLD
from veldt.registry import query
from veldt.sources import adapter as A

# A request's columns, from the supplier's key k; both engines read these expressions. Faults are planted in most fields.
_REQUEST = {
    "period": "CASE WHEN k % 31 = 5 THEN ' ' ELSE '2024' END",
    "as_of_date": "CASE WHEN k % 37 = 5 THEN 'unknown' ELSE '2024-07-01' END",
    "stage": "CASE WHEN k % 29 = 5 THEN 'other' WHEN k % 3 = 0 THEN 'startup' WHEN k % 3 = 1 THEN 'growth' ELSE 'stable' END",
    "papers": "CAST(CASE WHEN k % 11 = 1 THEN NULL WHEN k % 13 = 1 THEN '-1' WHEN k % 17 = 1 THEN '2.5' ELSE CAST(k % 40 AS STRING) END AS DOUBLE)",
    "valid_patents": "CAST(CASE WHEN k % 19 = 1 THEN 'NaN' ELSE CAST(k * 37 AS STRING) END AS DOUBLE)",
    "rd": "CAST(CASE WHEN k % 7 = 1 THEN NULL ELSE k % 9 END AS DOUBLE)",
    "revenue": "CAST(CASE WHEN k % 23 = 1 THEN -5 ELSE k % 13 END AS DOUBLE)",
    "ip": "CAST(k % 50 AS DOUBLE)",
    "staff": "CAST(CASE WHEN k % 6 = 1 THEN NULL ELSE k % 17 END AS DOUBLE)",
    "contract": "CAST(k * 1250 AS DOUBLE) / CAST(4 AS DOUBLE)",
    "negative_probability": "CAST(k % 9 AS DOUBLE) / CAST(8 AS DOUBLE) + CAST(CASE WHEN k % 21 = 1 THEN 1 ELSE 0 END AS DOUBLE)",
    "applications": "CAST(k % 70 AS DOUBLE)",
    "grants": "CAST(k % 31 AS DOUBLE)",
    "intangible": "CAST(k % 19 AS DOUBLE)",
    "net_assets": "CAST(k % 8 AS DOUBLE)",
    "trl": "CAST(k % 11 AS DOUBLE)",
    "core_revenue": "CAST(k % 12 AS DOUBLE)",
}
_METRIC = "CASE WHEN event_id % 41 < 6 THEN concat('tqi-00', event_id % 41 + 1) WHEN event_id % 41 < 14 THEN concat('tqc-00', event_id % 41 - 5) ELSE 'other' END"
_STRENGTH = "CASE kind WHEN 'screening' THEN 'direct' WHEN 'inquiry' THEN 'inferred' ELSE 'background' END"
_REFERENCE = {
    "metric_id": _METRIC,
    "locator": "CASE WHEN event_id % 7 = 0 THEN ' ' ELSE concat('p. ', event_id % 100) END",
    "strength": f"CASE WHEN event_id % 11 = 0 THEN 'direct' ELSE {_STRENGTH} END",
    "basis": "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'stated' END",
}
_GOVERNED = {"g_company": "CASE WHEN event_id % 13 = 0 THEN 'star-000000' ELSE company_id END", "g_strength": _STRENGTH, "g_basis": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'governed' END"}


def requests(spark, folder):
    k = A.companies(spark, folder).withColumn("k", F.col("s_suppkey"))
    return k.select("company_id", *[F.expr(e).alias(n) for n, e in _REQUEST.items()])


def _eligible(spark, folder):
    events = A.events(spark, folder)
    named = F.concat(F.lit("ev-"), "event_id").alias("evidence_id")
    references = events.select("company_id", named, *[F.expr(e).alias(n) for n, e in _REFERENCE.items()])
    governed = events.select(named, *[F.expr(e).alias(n.replace("g_company", "company_id").replace("g_", "")) for n, e in _GOVERNED.items()])
    return B.eligible(references, governed)


def _columns(d: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in d.items())


_REJECTED = "CASE WHEN trim(company_id) = '' THEN 'company' WHEN trim(period) = '' THEN 'period' WHEN try_cast(as_of_date AS DATE) IS NULL THEN 'as-of-date' WHEN stage NOT IN ('startup', 'growth', 'stable') THEN 'stage' END"
_BASE = f"""{O.COMPANIES}, {O.EVENTS}, req AS (SELECT company_id, {_columns(_REQUEST)} FROM (SELECT *, s_suppkey AS k FROM companies)),
refs AS (SELECT company_id, 'ev-' || event_id AS evidence_id, {_columns(_REFERENCE)}, {_columns(_GOVERNED)} FROM risk_events),
good AS (SELECT company_id, metric_id, evidence_id, strength FROM refs WHERE trim(locator) <> '' AND company_id = g_company AND strength = g_strength AND (strength = 'direct' OR (strength = 'inferred' AND basis <> '' AND g_basis IS NOT NULL)))"""


@query(f"WITH {_BASE} SELECT company_id, {_REJECTED} AS error FROM req")
def baseline_request_errors(spark, folder):
    return requests(spark, folder).select("company_id", B.request_error().alias("error"))


@query(f"WITH {_BASE} SELECT * FROM good")
def baseline_evidence(spark, folder):
    return _eligible(spark, folder)


def _number(x: str, digits: int = 2) -> str:
    return rf"regexp_replace(regexp_replace(format('{{:,.{digits}f}}', round({x}, {digits})), '(\.\d*?)0+$', '\1'), '\.$', '')"


def _two(x: str) -> str:
    return f"floor(({x}) * 100 + CAST('0.5' AS DOUBLE)) / 100"


def _faults(f: str) -> str:
    _, whole, least, most = B.FIELDS[f]
    found = [f"CASE WHEN NOT isfinite({f}) THEN '{f}:finite' END"]
    found += [f"CASE WHEN isfinite({f}) AND {f} <> floor({f}) THEN '{f}:integer' END"] if whole else []
    found += [f"CASE WHEN isfinite({f}) AND {f} < {least} THEN '{f}:min' END"]
    found += [f"CASE WHEN isfinite({f}) AND {f} > {most} THEN '{f}:max' END"] if most is not None else []
    return f"nullif(concat_ws(';', {', '.join(found)}), '')"


def _row(metric: str, f: str, below: str | None, band: str | None, unit: str, name: str | None) -> str:
    at = int(metric[-1]) - 1
    weight = "CASE stage " + " ".join(f"WHEN '{s}' THEN {w[at]}" for s, w in B.WEIGHTS.items()) + " END" if metric.startswith("tqi") else "NULL"
    rule = f"'{band}'" if band else "NULL"
    if below is None:
        tail = f" {unit}。" if unit else "。"
        return f"('{metric}', {rule}, {weight}, {_faults(f)}, {f}, '{name or B.FIELDS[f][0]}=' || {_number(f, 2 if unit else 3)} || '{tail}')"
    zero = f"CASE WHEN {_faults(f)} IS NULL AND {_faults(below)} IS NULL AND {f} IS NOT NULL AND {below} = 0 THEN '{below}:zero' END"
    faults = f"concat_ws(';', {_faults(f)}, {_faults(below)}, {zero})"
    value = f"{f} / nullif({below}, 0) * 100" if unit == "%" else f"{f} / nullif({below} / 100, 0)"
    text = f"{_number(f)} || ' ÷ ' || {_number(below)} || ' × 100%=' || {_number(_two(value))} || '%。'" if unit == "%" else f"{_number(f)} || ' ÷ (' || {_number(below)} || ' ÷ 100)=' || {_number(_two(value))} || ' {unit}。'"
    return f"('{metric}', {rule}, {weight}, nullif({faults}, ''), {value}, '{name}=' || {text})"


_METRICS = f"""{_BASE}, rules(rule_id, low_op, low, medium_op, medium) AS (VALUES {C.as_values([(a, b, f"{c}", d, f"{e}") for a, b, c, d, e in C.BASELINE_BANDS])}),
counted AS (SELECT company_id, metric_id, count(*) AS n FROM good GROUP BY 1, 2),
each AS (SELECT company_id, period, u.* FROM (SELECT * FROM req WHERE {_REJECTED} IS NULL) req, LATERAL (VALUES {', '.join(_row(*m) for m in B.METRICS)}) u(metric_id, rule_id, weight, errors, input, formula)),
judged AS (SELECT each.*, coalesce(n, 0) AS n, low_op, CAST(low AS DOUBLE) AS low, medium_op, CAST(medium AS DOUBLE) AS medium,
  CASE WHEN errors IS NOT NULL THEN 'invalid-input' WHEN input IS NULL THEN 'missing' WHEN coalesce(n, 0) = 0 THEN 'ineligible-evidence' ELSE 'calculated' END AS status
  FROM each LEFT JOIN counted USING (company_id, metric_id) LEFT JOIN rules USING (rule_id)),
banded AS (SELECT *, status = 'calculated' AS done, CASE WHEN status <> 'calculated' OR rule_id IS NULL THEN NULL WHEN {_HOLD("input", "low_op", "low")} THEN 'low' WHEN {_HOLD("input", "medium_op", "medium")} THEN 'medium' ELSE 'high' END AS risk_band FROM judged),
metrics AS (SELECT company_id, period, metric_id, status, CASE WHEN done THEN {_two('input')} END AS value, weight, risk_band, CASE risk_band WHEN 'low' THEN 25 WHEN 'medium' THEN 60 WHEN 'high' THEN 85 END AS score,
  CASE WHEN done THEN n ELSE 0 END AS n_evidence, coalesce(errors, '') AS errors, CASE WHEN done THEN formula END AS formula FROM banded)"""


@query(f"WITH {_METRICS} SELECT * FROM metrics")
def baseline_metrics(spark, folder):
    return B.metrics(requests(spark, folder), _eligible(spark, folder), C.baseline_bands(spark))


@query(f"""WITH {_METRICS} SELECT company_id, period, count(*) FILTER (metric_id LIKE 'tqi%' AND status = 'calculated') AS quantified,
  CAST(coalesce(sum(weight) FILTER (status = 'calculated'), 0) AS BIGINT) AS quantified_weight, CAST(sum(weight) AS BIGINT) AS technology_weight,
  count(*) FILTER (metric_id LIKE 'tqc%' AND status = 'calculated') AS calibrated, count(score) AS with_band, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'invalid-input') AS invalid,
  count(*) FILTER (status = 'ineligible-evidence') AS ineligible, CASE WHEN count(*) FILTER (metric_id LIKE 'tqi%' AND status = 'calculated') = 6 THEN 'completed' ELSE 'partial' END AS status,
  CASE WHEN count(score) = 0 THEN 'pending' WHEN count(score) = 7 THEN 'complete' ELSE 'partial' END AS calibration_status FROM metrics GROUP BY 1, 2""")
def baseline_totals(spark, folder):
    return B.totals(baseline_metrics(spark, folder))
