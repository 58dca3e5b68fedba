"""What a reader sees of a company: overview of its events, dimensions, summary, trend, disclosures, evidence, observations.

Firsts and newest rows are `max_by` and `min` of structs, combined before the shuffle. Arrays hold what the
catalogue bounds (dimensions, indicators) or what a group limit cuts (links of a source).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.dates import months_before
from veldt.functions.text import not_applicable
from veldt.operators.bundle import used_sources
from veldt.operators.events import reliability
from veldt.operators.ordered import distinct_in_order
from veldt.operators.serving import top_k
from veldt.operators.taxonomy import LABELS
from veldt.plans.catalogue import CATALOGUE

DIMENSIONS = {d: [i for i, x, _, _ in CATALOGUE if x == d] for d in LABELS}
INDICATORS = sum(map(len, DIMENSIONS.values()))
#: kinds of events in the order in which those of one day are listed
KINDS = ("deep-search", "screening", "inquiry", "litigation")
# How many a view lists, cuts and texts of the views.
TOP_RISKS, LINKS, DISCLOSED, TREND = 2, 20, 16, 6
LEVELS = ((75, "high"), (60, "medium-high"), (40, "attention"))
NO_HIGH_EVENT = "暂无已核验高风险事件"
NO_SCORE, SCORED = "当前同业组尚无可比评分值，保留覆盖与原始观测。", ("由 ", " 同业可比观测形成候选维度值。")
DERIVED, LEAST_DERIVED, LEAST_DIRECT = "licensed-derived", 0.65, 0.75
NARRATIVE = LABELS["narrative"]
OFFICIAL_NAMES, FILING_NAMES = "官方|上交所|交易所|联邦公报", "年报|定期报告|招股"


def _order(kind: str = "kind") -> Column:
    """Ascending in what is listed later: of events the newest come first, of one day by kind, then by id."""
    return F.struct("event_date", (-F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind))).alias("k"), (-F.col("event_id")).alias("i"))


def level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][0], LEVELS[0][1])
    for cut, name in LEVELS[1:]:
        out = out.when(score >= cut, name)
    return out.otherwise("low")


def _whole_mean(score: str) -> Column:
    """Mean of scores of two decimals, rounded half up, in whole numbers throughout."""
    n = F.count(score)
    return F.when(n > 0, F.floor((2 * F.sum(F.round(F.col(score) * 100).cast("long")) + 100 * n) / (200 * n)))


def event_overview(events: DataFrame) -> DataFrame:
    """Per company: numbers of high, medium and all events, the newest (lead) event, the title of the newest high one.

    events: company_id, event_id (number), kind, event_type, title, indicator_id, event_date, severity.
    """
    high = F.col("severity") == "high"
    by = events.groupBy("company_id").agg(
        F.count_if(high).alias("high_events"), F.count_if(F.col("severity") == "medium").alias("medium_events"), F.count("*").alias("events"),
        F.max_by(F.struct("event_id", "event_type", "indicator_id"), _order()).alias("_lead"), F.max_by("title", F.when(high, _order())).alias("high_title"),
    )
    return by.select("company_id", "high_events", "medium_events", "events", F.col("_lead.event_id").alias("lead_event_id"), F.col("_lead.event_type").alias("lead_event_type"), F.col("_lead.indicator_id").alias("lead_indicator_id"), "high_title")


def _dimensions() -> Column:
    return F.array(*(F.struct(F.lit(p).alias("place"), F.lit(d).alias("dimension_id"), F.lit(LABELS[d]).alias("label"), F.lit(f"{len(i)}/{INDICATORS}").alias("weight")) for p, (d, i) in enumerate(DIMENSIONS.items())))


def company_dimensions(companies: DataFrame, scores: DataFrame) -> DataFrame:
    """All six dimensions of every company: whole mean of its scored indicators (0 and low where none is), share of indicators, and what the score rests on.

    scores: company_id, dimension_id, indicator_id, risk_score.
    """
    by = scores.where("risk_score IS NOT NULL").groupBy("company_id", "dimension_id").agg(_whole_mean("risk_score").alias("_score"), F.array_sort(F.collect_set("indicator_id")).alias("indicator_ids"))
    every = companies.select("company_id", F.explode(_dimensions()).alias("d")).select("company_id", "d.*")
    ids = F.coalesce("indicator_ids", F.array().cast("array<string>"))
    summary = F.when(F.col("_score").isNull(), NO_SCORE).otherwise(F.concat(F.lit(SCORED[0]), F.array_join(ids, "、"), F.lit(SCORED[1])))
    return every.join(by, ["company_id", "dimension_id"], "left").select(
        "company_id", "dimension_id", "place", "label", "weight", F.coalesce("_score", F.lit(0)).alias("score"), level(F.coalesce("_score", F.lit(0))).alias("level"), ids.alias("indicator_ids"), summary.alias("summary")
    )


def company_summaries(companies: DataFrame, totals: DataFrame, dimensions: DataFrame, overview: DataFrame, evidence: DataFrame, peers: DataFrame) -> DataFrame:
    """A row a company: index, the two gravest dimensions, evidence, events by severity, the newest high event, the peer to compare with.

    totals: company_id, total_score; dimensions: company_id, dimension_id, dimension_score (null: not scored); overview as of
    event_overview; evidence: rows of company_id, source_id; peers: company_id, next_company_id. Dimensions of one score keep their order.
    """
    places = F.create_map(*(F.lit(x) for p, d in enumerate(DIMENSIONS) for x in (d, F.struct(F.lit(p).alias("p"), F.lit(LABELS[d]).alias("label")))))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("dimension_score")).alias("s"), places[F.col("dimension_id")].alias("d"))))
    top = dimensions.where("dimension_score IS NOT NULL").groupBy("company_id").agg(F.transform(F.slice(ranked, 1, TOP_RISKS), lambda x: x["d"]["label"]).alias("top_risks"))
    sources = evidence.groupBy("company_id").agg(F.count("*").alias("_sources"))
    joined = companies.select("company_id", F.col("short_name").alias("name"))
    for part in (totals.select("company_id", F.col("total_score").alias("risk_index")), top, overview, sources, peers.select("company_id", F.col("next_company_id").alias("benchmark_company_id"))):
        joined = joined.join(part, "company_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "company_id", "name", "risk_index", F.coalesce("top_risks", F.array().cast("array<string>")).alias("top_risks"), (zero("_sources") + zero("events")).alias("evidence_count"),
        zero("high_events").alias("high_events"), zero("medium_events").alias("medium_events"), F.coalesce("benchmark_company_id", "company_id").alias("benchmark_company_id"), F.coalesce("high_title", F.lit(NO_HIGH_EVENT)).alias("current_high_event"),
    )


def company_trend(companies: DataFrame, events: DataFrame, snapshot: str) -> DataFrame:
    """High, medium and all events of every company in each of the last six months, months without events included."""
    back = [F.date_format(months_before(F.lit(snapshot), n), "yyyy-MM") for n in range(TREND - 1, -1, -1)]
    every = companies.select("company_id", F.explode(F.array(*back)).alias("month"))
    by = events.groupBy("company_id", F.substring("event_date", 1, 7).alias("month")).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.count("*").alias("total")
    )
    return every.join(by, ["company_id", "month"], "left").fillna(0, ["high", "medium", "total"])


def latest_by_indicator(observations: DataFrame, position: str = "observation_id") -> DataFrame:
    """The newest observation of each company and indicator; of one day's the first by position. Undated ones are the oldest."""
    rest = [c for c in observations.columns if c not in ("company_id", "indicator_id")]
    newest = observations.groupBy("company_id", "indicator_id").agg(F.max(F.coalesce("as_of_date", F.lit(""))).alias("_day"))
    dated = observations.join(newest, ["company_id", "indicator_id"]).where(F.coalesce("as_of_date", F.lit("")) == F.col("_day"))
    return dated.groupBy("company_id", "indicator_id").agg(F.min(F.struct(F.col(position).alias("_p"), *rest)).alias("r")).select("company_id", "indicator_id", *(F.col(f"r.{c}") for c in rest))


def shown_value(number: Column, unit: Column, text: Column, status: Column) -> Column:
    """A number with groups of thousands, four decimals at most and its unit, else the text, else the status."""
    shown = F.call_function("format_number", F.round(number, 4), F.lit("#,##0.####"))
    return F.when(number.isNotNull(), F.concat(shown, F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise(""))).otherwise(F.coalesce(F.nullif(text, F.lit("")), status))


def disclosures(latest: DataFrame) -> DataFrame:
    """The first sixteen newest observations of every company in the order of indicators, as text, numbered from 1.

    latest: as of latest_by_indicator, with numeric_value, unit, text_value, status.
    """
    rows = F.slice(F.array_sort(F.collect_list(F.struct("indicator_id", "metric_name", shown_value(F.col("numeric_value"), F.col("unit"), F.col("text_value"), F.col("status")).alias("value"), F.col("as_of_date").alias("period")))), 1, DISCLOSED)
    return latest.groupBy("company_id").agg(rows.alias("rows")).select("company_id", F.posexplode("rows").alias("p", "r")).select("company_id", (F.col("p") + 1).alias("place"), "r.*")


def source_evidence(observations: DataFrame, supplements: DataFrame, sources: DataFrame, position: str = "observation_id") -> DataFrame:
    """Every source that a company's rows name, with what it supports: indicators and dimensions as first seen, confidence, up to twenty places.

    observations: company_id, indicator_id, metric_name, as_of_date, unit, confidence, source_id, source_ids and a position;
    supplements: company_id, source_id; sources: source_id, source_type, institution, redistribution. A source of supplements
    alone supports none: its dimension is the narrative one. A source unknown is left out.
    """
    every = F.array_distinct(F.array_compact(F.concat(F.array("source_id"), F.coalesce("source_ids", F.array().cast("array<string>")))))
    links = observations.select("company_id", "indicator_id", "metric_name", "as_of_date", "unit", "confidence", F.col(position).alias("_p"), F.explode(every).alias("source_id"))
    keys = ["company_id", "source_id"]
    named = used_sources([(observations, "source_id", "source_ids"), (supplements, "source_id", None)], sources)
    ids = distinct_in_order(links, keys, "indicator_id", "indicator_ids", "_p")
    most = links.groupBy(*keys).agg(F.max("confidence").alias("_confidence"), F.count("*").alias("observations"))
    place = F.concat_ws(":", "indicator_id", "as_of_date", "unit", "metric_name")
    shown = top_k(links, keys, [F.col("_p")], LINKS, "_k").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", place.alias("link")))), lambda x: x["link"]).alias("links"))
    labels = F.create_map(*(F.lit(x) for d, found in DIMENSIONS.items() for i in found for x in (i, LABELS[d])))
    none = F.array().cast("array<string>")
    indicators = F.coalesce("indicator_ids", none)
    dims = F.array_distinct(F.array_compact(F.transform(indicators, lambda i: F.try_element_at(labels, i))))
    derived = F.coalesce(F.col("redistribution") == DERIVED, F.lit(False))
    joined = named.join(ids, keys, "left").join(most, keys, "left").join(shown, keys, "left")
    return joined.select(
        *keys, reliability(F.col("source_type"), F.col("institution")).alias("reliability"), indicators.alias("indicator_ids"), F.when(F.size(dims) > 0, dims).otherwise(F.array(F.lit(NARRATIVE))).alias("dimensions"),
        F.greatest(F.when(derived, LEAST_DERIVED).otherwise(LEAST_DIRECT), "_confidence").alias("confidence"), F.when(derived, "background").otherwise("direct").alias("strength"),
        F.coalesce("observations", F.lit(0)).alias("observations"), F.coalesce("links", none).alias("links"),
    )


def indicator_observations(latest: DataFrame, coverage: DataFrame, sources: DataFrame) -> DataFrame:
    """The newest observation of every company and indicator with its status: available where coverage may be scored, partial where there is any, else unavailable.

    coverage: company_id, indicator_id, status, usable, one row a pair; sources: source_id. Evidence is the source, if it is known.
    """
    known = sources.select("source_id", F.lit(True).alias("_known")).distinct()
    usable, some = F.coalesce("usable", F.lit(False)), F.col("_status").isNotNull() & ~F.coalesce(not_applicable(F.col("_status")), F.lit(False))
    joined = latest.drop("status").join(coverage.select("company_id", "indicator_id", F.col("status").alias("_status"), "usable"), ["company_id", "indicator_id"], "left").join(known, "source_id", "left")
    return joined.select(
        "company_id", "indicator_id", "observation_id", F.when(usable, "available").when(some, "partial").otherwise("unavailable").alias("status"), F.when(usable, "reviewed").otherwise("pending").alias("review_status"),
        F.col("as_of_date").alias("period"), F.when(F.col("_known"), F.concat(F.lit("r01-evidence:"), "source_id")).alias("evidence_id"),
    )


def manifest_statistics(sources: DataFrame, events: DataFrame, supplements: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of totals: sources (all, official, filings), events (all, of deep search), supplements, and evidence (sources of companies and events)."""
    text = lambda *cs: F.concat(*(F.coalesce(c, F.lit("")) for c in cs))
    s = sources.agg(F.count("*").alias("sources"), F.count_if(text("source_type", "institution").rlike(OFFICIAL_NAMES)).alias("official"), F.count_if(text("source_type", "title").rlike(FILING_NAMES)).alias("filings"))
    e = events.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "deep-search").alias("deep_search"))
    rows = [s, e, supplements.agg(F.count("*").alias("supplements")), evidence.agg(F.count("*").alias("_evidence"))]
    out = rows[0]
    for one in rows[1:]:
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out.select("sources", "official", "filings", "events", "deep_search", "supplements", (F.col("_evidence") + F.col("events")).alias("evidence"))
