"""Rules of a fixed-weight scoring request on its header, evidence, references, events and paths: tables of violations.

Each function gives (company_id, rule, entity) for all that is wrong; no rule stops another.
fixedweight.request_errors holds the rules on single indicators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.numeric import finite
from veldt.functions.text import http_url
from veldt.operators.fixedweight import STRENGTHS, effective_evidence
from veldt.plans.catalogue import FIXED_METHOD_VERSION

# What a request may say.
COVERAGE = {"complete": 1.0, "partial": 0.75, "missing": 0.0}
SEVERITIES = ("critical", "high", "medium", "low", "watch")
TIERS = ("regulator", "exchange", "company-filing", "official-company", "commercial-api", "research", "media", "manual")


def blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0


def within(c: Column, low: float, high: float) -> Column:
    """A finite number between two bounds; false for null."""
    return F.coalesce(finite(c) & c.between(low, high), F.lit(False))


def _found(df: DataFrame, entity: str, rules: list[tuple[str, Column]]) -> DataFrame:
    hits = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules)))
    return df.select("company_id", F.explode(hits).alias("rule"), F.coalesce(F.col(entity).cast("string"), F.lit("")).alias("entity"))


def _twice(df: DataFrame, key: str, rule: str) -> DataFrame:
    again = df.where(~blank(F.col(key))).groupBy("company_id", key).count().where("count > 1")
    return again.select("company_id", F.lit(rule).alias("rule"), F.col(key).alias("entity"))


def header_errors(requests: DataFrame) -> DataFrame:
    """requests: company_id, method_version, assessment_at, data_cutoff."""
    return _found(requests, "company_id", [
        ("method-version", ~F.col("method_version").eqNullSafe(FIXED_METHOD_VERSION)),
        ("company-empty", blank(F.col("company_id"))),
        ("assessment-time-empty", blank(F.col("assessment_at"))),
        ("data-cutoff-empty", blank(F.col("data_cutoff"))),
    ])


def evidence_errors(evidence: DataFrame) -> DataFrame:
    """evidence: company_id, evidence_id, title, source_name, locator, source_tier, url, published_at (null, or not blank)."""
    return _found(evidence, "evidence_id", [
        ("evidence-without-id", blank(F.col("evidence_id"))),
        ("evidence-without-title-source-or-place", blank(F.col("title")) | blank(F.col("source_name")) | blank(F.col("locator"))),
        ("unknown-tier", ~F.coalesce(F.col("source_tier").isin(*TIERS), F.lit(False))),
        ("unsafe-url", ~F.coalesce(http_url(F.col("url")), F.lit(False))),
        ("publication-blank", F.col("published_at").isNotNull() & blank(F.col("published_at"))),
    ]).unionByName(_twice(evidence, "evidence_id", "duplicate-evidence"))


def status_errors(indicators: DataFrame) -> DataFrame:
    """Status against coverage and confidence. indicators: company_id, indicator_id, data_status, coverage_factor, evidence_confidence."""
    expected = F.create_map(*[F.lit(x) for pair in COVERAGE.items() for x in pair])
    return _found(indicators, "indicator_id", [
        ("status-against-coverage", ~F.try_element_at(expected, F.col("data_status")).eqNullSafe(F.col("coverage_factor"))),
        ("missing-with-confidence", (F.col("data_status") == "missing") & ~F.col("evidence_confidence").eqNullSafe(0.0)),
    ])


def reference_errors(references: DataFrame, evidence: DataFrame, indicators: DataFrame) -> DataFrame:
    """References of indicators to evidence, and scored indicators without an effective one.

    references: company_id, indicator_id, evidence_id, locator, strength, basis.
    """
    known = evidence.select("company_id", "evidence_id").distinct().withColumn("_known", F.lit(True))
    joined = references.join(known, ["company_id", "evidence_id"], "left").withColumn("_e", F.concat_ws("|", "indicator_id", "evidence_id"))
    own = _found(joined, "_e", [
        ("unknown-evidence", F.col("_known").isNull()),
        ("reference-without-place", blank(F.col("locator"))),
        ("unknown-strength", ~F.coalesce(F.col("strength").isin(STRENGTHS), F.lit(False))),
        ("inference-without-basis", (F.col("strength") == "inferred") & blank(F.col("basis"))),
    ])
    counted = references.where(effective_evidence(F.col("strength"), F.col("basis"))).select("company_id", "indicator_id").distinct()
    bare = indicators.where("risk_score IS NOT NULL").join(counted, ["company_id", "indicator_id"], "left_anti")
    return own.unionByName(bare.select("company_id", F.lit("scored-without-evidence").alias("rule"), F.col("indicator_id").alias("entity")))


def event_errors(events: DataFrame, evidence: DataFrame, indicator_ids: list[str]) -> DataFrame:
    """events: company_id, event_id, title, summary, severity, red_flag, source_indicator_ids, evidence_ids."""
    own = _found(events, "event_id", [
        ("event-without-id", blank(F.col("event_id"))),
        ("event-without-title-or-summary", blank(F.col("title")) | blank(F.col("summary"))),
        ("unknown-severity", ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))),
        ("flag-not-boolean", F.col("red_flag").isNull()),
        ("event-without-indicators", F.col("source_indicator_ids").isNull()),
        ("event-of-unknown-indicator", F.exists("source_indicator_ids", lambda i: ~F.coalesce(i.isin(indicator_ids), F.lit(False)))),
        ("event-without-evidence-list", F.col("evidence_ids").isNull()),
        ("red-flag-without-evidence", F.col("red_flag") & (F.size("evidence_ids") == 0)),
    ])
    known = evidence.select("company_id", F.col("evidence_id").alias("e")).distinct()
    named = events.select("company_id", "event_id", F.explode("evidence_ids").alias("e")).join(known, ["company_id", "e"], "left_anti")
    unknown = named.select("company_id", F.lit("event-of-unknown-evidence").alias("rule"), F.concat_ws("|", "event_id", "e").alias("entity"))
    return own.unionByName(unknown).unionByName(_twice(events, "event_id", "duplicate-event"))


def path_errors(paths: DataFrame, events: DataFrame) -> DataFrame:
    """paths: company_id, path_id, event_id, event_risk_score, edges (relation_id, strength, time_decay, business_relevance)."""
    unsound = F.exists("edges", lambda e: e["relation_id"].isNull() | ~within(e["strength"], 0, 1) | ~within(e["time_decay"], 0, 1) | ~within(e["business_relevance"], 0, 1))
    known = events.select("company_id", "event_id").distinct().withColumn("_known", F.lit(True))
    joined = paths.join(known, ["company_id", "event_id"], "left")
    return _found(joined, "path_id", [
        ("path-without-id", blank(F.col("path_id"))),
        ("path-of-unknown-event", F.col("_known").isNull()),
        ("path-score-out-of-range", ~within(F.col("event_risk_score"), 0, 100)),
        ("path-without-edges", F.coalesce(F.size("edges"), F.lit(0)) <= 0),
        ("unsound-edge", unsound),
    ]).unionByName(_twice(paths, "path_id", "duplicate-path"))
