"""Static configuration tables of the scoring models: fixed values, stated plainly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Model versions (fixed values).
INDUSTRY_CRITIC_VERSION = "IRAWC-CRITIC-2026.08-v2"
INDUSTRY_FULL_VERSION = "IRAWC-FULL-2026.08-v2"
FIXED_SCORE_VERSION = "KCR-SCORE-2026.08-v3"
FIXED_METHOD_VERSION = "KCR-2026.08-v1"
FIXED_DATA_VERSION = "KCR-DATA-2026.08-v1"
TECHNOLOGY_VERSION = "KTR-2026.07-v1"
BASELINE_VERSION = "TQB-2026.07-v5"

# Metric catalogue (fixed values): indicator, dimension, direction, candidates (metric, comparable group) by priority.
CATALOGUE = [
    ("R01", "narrative", "up", [("finance_news_retrieved_count_proxy", "finance-news-volume")]),
    ("R02", "narrative", "up", [("third_party_negative_news_share_pct_proxy", "negative-news-share")]),
    ("R03", "narrative", "down", [("formal_report_narrative_similarity_proxy", "narrative-similarity")]),
    ("R04", "narrative", "up", [("concept_keyword_news_share_pct_proxy", "concept-news-share")]),
    ("R05", "technology", "down", [
        ("cnipa_core_operating_entity_valid_count", "cnipa-valid-count"),
        ("cnipa_listed_entity_valid_count", "cnipa-valid-count"),
        ("patent_authorized_count_proxy", "authorized-patent-count"),
        ("patent_total_count_proxy", "patent-total-count"),
        ("tyc_paid_patent_total_asof", "tyc-patent-total"),
    ]),
    ("R06", "technology", "down", [("rd_personnel_ratio_pct", "rd-personnel-ratio")]),
    ("R07", "technology", "down", [("rd_intensity_pct", "rd-intensity")]),
    ("R08", "technology", "up", [
        ("fundraising_project_delay_event_count", "milestone-delay-events"),
        ("rd_negative_milestone_event_count", "negative-milestone-events"),
        ("fundraising_project_change_event_count", "project-change-events"),
    ]),
    ("R09", "technology", "up", [
        ("tyc_paid_patent_page_adverse_status_count", "patent-adverse-sample"),
        ("cnipa_verified_adverse_patent_legal_event_count", "cnipa-adverse-events"),
        ("technology_ip_quality_event_count", "technology-ip-events"),
        ("manufacturing_quality_inspection_event_count", "quality-events"),
    ]),
    ("R10", "compliance", "up", [
        ("tyc_paid_admin_penalty_total_asof", "administrative-penalties"),
        ("securities_regulatory_penalty_or_measure_count_last5y", "securities-regulatory-measures"),
        ("official_penalty_related_announcement_count", "official-penalty-events"),
    ]),
    ("R11", "compliance", "up", [
        ("exchange_inquiry_topic_count", "exchange-inquiry-count"),
        ("exchange_inquiry_topic_count_ytd", "exchange-inquiry-count-ytd"),
    ]),
    ("R12", "compliance", "up", [
        ("tyc_paid_lawsuit_total_asof", "tyc-lawsuit-count"),
        ("defendant_judgment_count", "defendant-judgment-count"),
        ("major_litigation_disclosure", "major-litigation-count"),
        ("litigation_arbitration_announcement_count", "litigation-announcement-count"),
    ]),
    ("R13", "finance", "down", [("revenue_growth_pct", "revenue-growth")]),
    ("R14", "finance", "up", [
        ("intangible_assets_ratio_change_pp", "intangible-ratio-change"),
        ("intangible_assets_to_total_assets_pct", "intangible-assets-ratio"),
        ("intangible_assets_ratio_pct", "intangible-assets-ratio"),
    ]),
    ("R15", "finance", "up", [
        ("debt_financing_cost_average_debt_proxy_pct", "average-debt-cost"),
        ("debt_financing_cost_ending_debt_proxy_pct", "ending-debt-cost"),
        ("interest_expense_yuan", "interest-expense"),
    ]),
    ("R16", "finance", "down", [
        ("ocf_short_debt_coverage", "ocf-short-debt-coverage"),
        ("cash_short_debt_ratio", "cash-short-debt-ratio"),
    ]),
    ("R17", "external", "down", [("tyc_paid_supplier_domestic_profile_count", "domestic-supplier-profile-count")]),
    ("R18", "external", "up", [("overseas_revenue_ratio_pct", "overseas-revenue-ratio")]),
    ("R19", "external", "up", [("export_control_list_hits", "export-control-list-hits")]),
    ("R20", "personnel", "down", [("maximum_controller_ratio_pct", "controller-ratio")]),
    ("R21", "personnel", "up", [
        ("tyc_core_entity_enterprise_risk_total_asof", "enterprise-risk-total"),
        ("tyc_paid_enterprise_risk_total_asof", "enterprise-risk-total"),
    ]),
    ("R22", "personnel", "up", [
        ("core_tech_departure_event_count", "core-personnel-events"),
        ("core_tech_departure_event_count_annual_report", "core-personnel-events"),
        ("core_tech_personnel_change_announcement_count", "core-personnel-events"),
        ("core_tech_change_official_announcement_count", "core-personnel-events"),
    ]),
]
#: The composite metric and its parts, either of which may be missing.
COMPOSITE = "export_control_list_hits"
COMPOSITE_PARTS = ["us_csl_distinct_list_hit_count", "eu_fsd_exact_name_hit_count"]
DIMENSIONS = ["technology", "compliance", "finance", "external", "personnel"]

# Fixed-weight model: indicator, dimension, weight; and weights of the dimensions (fixed values).
FIXED_WEIGHTS = [
    ("T01", "technology", 4), ("T02", "technology", 5), ("T03", "technology", 6), ("T04", "technology", 5), ("T05", "technology", 5),
    ("C01", "compliance", 5), ("C02", "compliance", 4), ("C03", "compliance", 11),
    ("F01", "finance", 6), ("F02", "finance", 4), ("F03", "finance", 4), ("F04", "finance", 6),
    ("E01", "external", 7), ("E02", "external", 4), ("E03", "external", 9),
    ("P01", "personnel-governance", 5), ("P02", "personnel-governance", 4), ("P03", "personnel-governance", 6),
]
FIXED_DIMENSIONS = [("technology", 25), ("compliance", 20), ("finance", 20), ("external", 20), ("personnel-governance", 15)]

# Scenario presets: weight of each dimension of the fixed-weight model (fixed values).
PRESETS = {
    "technology-diligence": [40, 15, 15, 15, 15],
    "compliance-external": [15, 30, 15, 30, 10],
}

# Technology model: weight of each indicator (fixed values).
TECHNOLOGY_WEIGHTS = [
    ("kci-006", 10), ("kci-007", 8), ("kci-008", 9), ("kci-009", 8), ("kci-010", 20), ("kci-011", 15), ("kci-012", 18), ("kci-013", 12),
]

# Threshold rules: indicator, low-risk bound, medium-risk bound, direction of the risk, whether bounds are strict (fixed values).
THRESHOLD_RULES = [
    ("kci-004", ">", 30.0, ">=", 10.0),
    ("kci-014", "=", 0.0, "<=", 2.0),
    ("kci-015", "=", 0.0, "<=", 2.0),
    ("kci-024", "<", 20.0, "<=", 50.0),
    ("kci-026", ">", 10.0, ">=", -10.0),
    ("kci-028", ">", 24.0, ">=", 12.0),
    ("kci-030", ">", 120.0, ">=", 100.0),
    ("kci-035", "<", 30.0, "<=", 60.0),
    ("kci-038", "<", 10.0, "<=", 40.0),
    ("kci-039", "=", 0.0, "=", 1.0),
]
#: Scores of a threshold rule's three outcomes.
LOW_RISK, MEDIUM_RISK, HIGH_RISK = 25, 60, 85

# Bands of the technology baseline: metric, low-risk bound, medium-risk bound (fixed values).
BASELINE_BANDS = [
    ("papers", ">", 20.0, ">=", 5.0),
    ("applications", ">", 50.0, ">=", 10.0),
    ("grant_rate", ">", 60.0, ">=", 30.0),
    ("rd_intensity", ">", 15.0, ">=", 5.0),
    ("trl", ">=", 7.0, ">=", 4.0),
    ("core_revenue", ">", 70.0, ">=", 30.0),
    ("negative_probability", "<", 0.2, "<=", 0.5),
]


def candidates(spark: SparkSession) -> DataFrame:
    """indicator_id, dimension_id, direction, rank, metric_name, comparable_group."""
    rows = [(i, d, way, k, m, g) for i, d, way, found in CATALOGUE for k, (m, g) in enumerate(found)]
    schema = "indicator_id string, dimension_id string, direction string, rank int, metric_name string, comparable_group string"
    return spark.createDataFrame(rows, schema)


def indicators(spark: SparkSession) -> DataFrame:
    rows = [(i, d, way, "narrative" if d == "narrative" else "weighted") for i, d, way, _ in CATALOGUE]
    return spark.createDataFrame(rows, "indicator_id string, dimension_id string, direction string, kind string")


def fixed_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_WEIGHTS, "indicator_id string, dimension_id string, weight int")


def fixed_dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_DIMENSIONS, "dimension_id string, dimension_weight int")


def presets(spark: SparkSession) -> DataFrame:
    rows = [(p, d, w) for p, ws in PRESETS.items() for (d, _), w in zip(FIXED_DIMENSIONS, ws, strict=True)]
    return spark.createDataFrame(rows, "preset_id string, dimension_id string, preset_weight int")


def threshold_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLD_RULES, "rule_id string, low_op string, low double, medium_op string, medium double")


def baseline_bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASELINE_BANDS, "rule_id string, low_op string, low double, medium_op string, medium double")


def as_values(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list."""

    def one(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
