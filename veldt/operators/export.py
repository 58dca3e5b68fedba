"""References of a company's report: every source that its dimensions, events and bindings lead to, once, numbered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.operators.ordered import distinct_in_order

# Words of the references (fixed values).
BOTH, BOTH_UNSCORED, SCORED, UNSCORED, EVENT = "事件来源 + 评分证据", "事件来源 + 评分观测（未计分）", "评分证据", "评分观测来源（未计分）", "事件来源"
NO_SOURCE, NO_TITLE, DIRECT_TITLE, PENDING, YES, NO = "来源记录缺失", "未找到对应证据记录", "事件直接来源", "待治理", "是", "否"
SUPPORT = {"direct": "直接披露", "inferred": "推导支持", "background": "背景材料", "pending": "待核验"}
#: the basis of a dimension whose evidence counts for its score without a binding
AUTOMATIC = "technology-auto-score"

COMPANY = "company_id"


def _listed(df: DataFrame, value: str, into: str) -> DataFrame:
    """company_id, evidence_id and the distinct values in their order (`at`)."""
    return distinct_in_order(df.where(F.col(value).isNotNull()), [COMPANY, "evidence_id"], value, into, "at")


def _number(n: Column) -> Column:
    text = n.cast("string")
    return F.concat(F.lit("SRC-"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def scoring_links(bindings: DataFrame) -> DataFrame:
    """company_id, evidence_id, indicator_id, period, locator, at: bindings with all three, trimmed, each once, as first seen."""
    names = ["indicator_id", "period", "locator"]
    trimmed = bindings.select(COMPANY, "evidence_id", *[F.trim(c).alias(c) for c in names], "place").where(" AND ".join(f"{c} <> ''" for c in names))
    return trimmed.groupBy(COMPANY, "evidence_id", *names).agg(F.min("place").alias("at"))


def references(dimensions: DataFrame, events: DataFrame, bindings: DataFrame, evidence: DataFrame) -> DataFrame:
    """References of every company's report.

    dimensions: company_id, label, place, score, score_basis, evidence_ids, indicator_ids; events: company_id, event_id, place,
    evidence_ids, source_url, source_name, source_type, risk_type, source_published_at, identified_at; bindings: company_id,
    evidence_id, indicator_id, period, locator, place; evidence: company_id, evidence_id, source_name, title,
    published_at, source_url, support. Returns company_id, number, reference_id, role, evidence_id, source_name, title, published_at,
    source_url, support, eligible, and arrays indicator_ids, periods, locators, event_ids, dimension_labels.

    Evidence comes in the order in which dimensions, then events, then bindings first name it; what no record holds
    is named as missing. After it come addresses of events that none of the event's evidence has, each once.
    """
    step = lambda rank: F.struct(F.lit(rank).alias("list"), F.col("place").cast("long").alias("place"), F.col("i").alias("i")).alias("at")
    by_dimension = dimensions.select(COMPANY, "label", "place", "score", "score_basis", "indicator_ids", F.posexplode("evidence_ids").alias("i", "evidence_id")).withColumn("at", step(0))
    by_event = events.select(COMPANY, "event_id", "place", F.posexplode("evidence_ids").alias("i", "evidence_id")).withColumn("at", step(1))
    by_binding = bindings.withColumn("i", F.lit(0)).withColumn("at", step(2))
    every = reduce(DataFrame.unionByName, [df.select(COMPANY, "evidence_id", "at") for df in (by_dimension, by_event, by_binding)])
    first = every.where("evidence_id IS NOT NULL").groupBy(COMPANY, "evidence_id").agg(F.min("at").alias("at"))
    automatic = by_dimension.where(F.col("score").isNotNull() & (F.col("score_basis") == AUTOMATIC)).select(COMPANY, "evidence_id", "at", F.posexplode("indicator_ids").alias("j", "indicator_id"))
    automatic = automatic.select(COMPANY, "evidence_id", "indicator_id", F.struct("at", "j").alias("at"))
    links = scoring_links(bindings)
    out = first
    for lists in (
        _listed(automatic, "indicator_id", "automatic"), _listed(links, "indicator_id", "linked"), _listed(links, "period", "periods"), _listed(links, "locator", "locators"),
        _listed(by_event, "event_id", "event_ids"), _listed(by_dimension, "label", "dimension_labels"),
    ):
        out = out.join(lists, [COMPANY, "evidence_id"], "left")
    none = F.array().cast("array<string>")
    for c in ("automatic", "linked", "periods", "locators", "event_ids", "dimension_labels"):
        out = out.withColumn(c, F.coalesce(c, none))
    has = lambda c: F.size(c) > 0
    scored = has("automatic") | (has("dimension_labels") & has("linked"))
    unscored = has("linked") & ~scored
    role = F.when(has("event_ids") & scored, BOTH).when(has("event_ids") & unscored, BOTH_UNSCORED).when(scored, SCORED).when(unscored, UNSCORED).otherwise(EVENT)
    support = reduce(lambda x, kv: x.when(F.col("support") == kv[0], kv[1]), SUPPORT.items(), F).otherwise(PENDING)
    known = out.join(evidence.withColumn("found", F.lit(True)), [COMPANY, "evidence_id"], "left")
    made = known.select(
        COMPANY, F.struct(F.lit(0).alias("kind"), F.col("at.list").alias("a"), F.col("at.place").alias("b"), F.col("at.i").alias("c")).alias("order"), role.alias("role"), "evidence_id", F.coalesce("source_name", F.lit(NO_SOURCE)).alias("source_name"),
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"), F.coalesce("published_at", F.lit("")).alias("published_at"), F.coalesce("source_url", F.lit("")).alias("source_url"), support.alias("support"),
        F.when(scored, YES).otherwise(NO).alias("eligible"), F.array_distinct(F.concat("automatic", "linked")).alias("indicator_ids"), "periods", "locators", "event_ids", "dimension_labels",
    )
    return _numbered(made.unionByName(direct_references(events, evidence)))


def direct_references(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Addresses of events that are not those of the events' own evidence: the first event's words, and all events of the address."""
    own = events.select(COMPANY, "event_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select(COMPANY, "evidence_id", "source_url"), [COMPANY, "evidence_id"]).select(COMPANY, "event_id", "source_url")
    rest = events.where(F.coalesce("source_url", F.lit("")) != "").join(own, [COMPANY, "event_id", "source_url"], "left_anti")
    event = F.struct("place", "event_id", F.coalesce("source_name", "source_type").alias("source_name"), F.concat("risk_type", F.lit(DIRECT_TITLE)).alias("title"), F.coalesce("source_published_at", "identified_at").alias("published_at"))
    by = rest.groupBy(COMPANY, "source_url").agg(F.min(event).alias("e"), F.array_sort(F.collect_set(F.struct("place", "event_id"))).alias("events"))
    none = F.array().cast("array<string>")
    return by.select(
        COMPANY, F.struct(F.lit(1).alias("kind"), F.lit(0).alias("a"), F.col("e.place").cast("long").alias("b"), F.lit(0).alias("c")).alias("order"), F.lit(EVENT).alias("role"), F.lit("").alias("evidence_id"), "e.source_name", "e.title", "e.published_at",
        "source_url", F.lit(PENDING).alias("support"), F.lit(NO).alias("eligible"), none.alias("indicator_ids"), none.alias("periods"), none.alias("locators"), F.array_distinct(F.transform("events", lambda x: x["event_id"])).alias("event_ids"), none.alias("dimension_labels"),
    )


def _numbered(made: DataFrame) -> DataFrame:
    """References of one company numbered in their order; a company's are few."""
    number = F.row_number().over(Window.partitionBy(COMPANY).orderBy("order", "evidence_id", "source_url"))
    return made.withColumn("number", number).drop("order").withColumn("reference_id", _number(F.col("number")))
