"""Graph of a fixed-weight assessment: company, dimensions, indicators, red-flag events and evidence.

All functions work on the assessments of any number of companies at once: rows carry company_id, and node
identifiers are unique within a company. Relations may be valid for a time; those in force on the
day of the assessment make the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.canonical import js_number
from veldt.operators.ordered import distinct_in_order

# Texts of nodes and edges (fixed values).
SUPPORT_LABELS = {"direct": "直接支持", "inferred": "推断支持", "background": "背景核验"}
LEVEL_LABELS = {"low": "低", "medium": "中", "high": "高", "critical": "极高"}
NO_LEVEL = "数据不足"
EVIDENCE_KINDS = list(SUPPORT_LABELS)


def _text(values: dict[str, str], c: Column, other: str) -> Column:
    return reduce(lambda out, kv: out.when(c == kv[0], kv[1]), list(values.items())[1:], F.when(c == next(iter(values)), next(iter(values.values())))).otherwise(other)


def _id(kind: str, c: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), c)


def _points(score: str) -> Column:
    return F.concat(F.coalesce(js_number(F.col(score).cast("double")), F.lit("—")), F.lit(" 分"))


def in_force(relations: DataFrame, assessments: DataFrame) -> DataFrame:
    """Relations (company_id, valid_from, valid_to) whose time holds the company's day of assessment (as_of).

    The first day counts, the last doesn't; null is open. Joined by company, the interval is a further condition.
    """
    day = assessments.select("company_id", "as_of")
    begun = F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("as_of"))
    lasting = F.col("valid_to").isNull() | (F.col("as_of") < F.col("valid_to"))
    return relations.join(day, "company_id").where(begun & lasting).drop("as_of")


def event_dimensions(red_flags: DataFrame, indicators: DataFrame) -> DataFrame:
    """company_id, event_id, dimension_ids: dimensions of a red flag's indicators, in the order of its list. Unknown indicators have none."""
    named = red_flags.select("company_id", "event_id", F.posexplode("indicator_ids").alias("place", "indicator_id"))
    known = named.join(indicators.select("company_id", "indicator_id", "dimension_id"), ["company_id", "indicator_id"])
    return distinct_in_order(known, ["company_id", "event_id"], "dimension_id", "dimension_ids", "place")


def evidence_dimensions(references: DataFrame, indicators: DataFrame) -> DataFrame:
    """company_id, evidence_id, dimension_ids: dimensions of the indicators that refer to it, in the order of the indicators (place)."""
    known = references.join(indicators.select("company_id", "indicator_id", "dimension_id", "place"), ["company_id", "indicator_id"])
    return distinct_in_order(known, ["company_id", "evidence_id"], "dimension_id", "dimension_ids", "place")


def nodes(
    assessments: DataFrame, dimensions: DataFrame, indicators: DataFrame, red_flags: DataFrame, references: DataFrame, catalogue: DataFrame
) -> DataFrame:
    """company_id, id, entity_id, kind, label, caption, score, tone, dimension_ids (array), place (order within the kind).

    assessments: company_id, label, score, level; dimensions: company_id, dimension_id, label, score, level, place;
    indicators: company_id, indicator_id, dimension_id, label, score, level, place; red_flags: company_id, event_id,
    title, severity, priority, indicator_ids (array), place; references: company_id, indicator_id, evidence_id;
    catalogue: company_id, evidence_id, title, source_name, place.
    """
    level = lambda c: F.concat(_text(LEVEL_LABELS, F.col(c), NO_LEVEL), F.lit("风险"))
    columns = ["company_id", "id", "entity_id", "kind", "label", "caption", "score", "tone", "dimension_ids", "place"]

    def made(df: DataFrame, kind: str, entity: str, label: str, caption: Column, score: Column, tone: Column, dims: Column, place: Column) -> DataFrame:
        values = [F.col("company_id"), _id(kind, entity), F.col(entity), F.lit(kind), F.col(label), caption, score, tone, dims, place]
        return df.select(*(v.alias(c) for v, c in zip(values, columns, strict=True)))

    no_score, calm = F.lit(None).cast("double"), F.coalesce("level", F.lit("neutral"))
    none = F.array().cast("array<string>")
    all_dims = distinct_in_order(dimensions, ["company_id"], "dimension_id", "dimension_ids", "place")
    company = assessments.join(all_dims, "company_id", "left")
    flags = red_flags.join(event_dimensions(red_flags, indicators), ["company_id", "event_id"], "left")
    proof = catalogue.join(evidence_dimensions(references, indicators), ["company_id", "evidence_id"], "left")
    score = F.col("score").cast("double")
    dot = F.lit(" · ")
    return (
        made(company, "company", "company_id", "label", F.concat(_points("score"), dot, level("level")), score, calm, F.coalesce("dimension_ids", none), F.lit(0))
        .unionByName(made(dimensions, "dimension", "dimension_id", "label", F.concat(_points("score"), dot, level("level")), score, calm, F.array("dimension_id"), F.col("place").cast("int")))
        .unionByName(made(indicators, "indicator", "indicator_id", "label", F.concat("indicator_id", dot, _points("score")), score, calm, F.array("dimension_id"), F.col("place").cast("int")))
        .unionByName(made(flags, "event", "event_id", "title", F.concat("priority", F.lit(" · 独立红旗")), no_score, F.when(F.col("severity").isin("critical", "high"), F.col("severity")).otherwise("medium"), F.coalesce("dimension_ids", none), F.col("place").cast("int")))
        .unionByName(made(proof, "evidence", "evidence_id", "title", F.concat("evidence_id", dot, "source_name"), no_score, F.lit("neutral"), F.coalesce("dimension_ids", none), F.col("place").cast("int")))
    )


def edges(dimensions: DataFrame, indicators: DataFrame, references: DataFrame, red_flags: DataFrame, paths: DataFrame) -> DataFrame:
    """company_id, id, source, target, kind, label, detail.

    Structure: company to dimension to indicator (weight). References: indicator to evidence, the kind is the support
    (direct, inferred, background). Event links: indicator to red flag, red flag to evidence. Propagation: red
    flag to company, for the included paths (path_id, event_id, included, trace) of events that are red flags.
    """
    columns = ["company_id", "id", "source", "target", "kind", "label", "detail"]

    def made(df: DataFrame, name: list, source: Column, target: Column, kind: str | Column, label: str | Column, detail: str | Column) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        values = [F.col("company_id"), F.concat_ws(":", *map(lit, name)), source, target, lit(kind), lit(label), lit(detail)]
        return df.select(*(v.alias(c) for v, c in zip(values, columns, strict=True)))

    c = F.col
    owner = _id("company", "company_id")
    support = c("support")
    linked = red_flags.select("company_id", "event_id", F.explode("indicator_ids").alias("indicator_id"))
    proven = red_flags.select("company_id", "event_id", F.explode("evidence_ids").alias("evidence_id"))
    spread = paths.where("included").join(red_flags.select("company_id", "event_id"), ["company_id", "event_id"], "left_semi")
    weight = F.concat(F.lit("固定权重 "), js_number(c("weight").cast("double")))
    return (
        made(dimensions, ["structure", c("company_id"), c("dimension_id")], owner, _id("dimension", "dimension_id"), "structure", "评估维度", "KCR V3 固定五维结构")
        .unionByName(made(indicators, ["structure", c("dimension_id"), c("indicator_id")], _id("dimension", "dimension_id"), _id("indicator", "indicator_id"), "structure", "包含指标", weight))
        .unionByName(made(references, ["evidence", c("indicator_id"), c("evidence_id"), support], _id("indicator", "indicator_id"), _id("evidence", "evidence_id"), support, _text(SUPPORT_LABELS, support, SUPPORT_LABELS["background"]), F.when(support == "inferred", c("inference_basis")).otherwise(c("locator"))))
        .unionByName(made(linked, ["event-indicator", c("event_id"), c("indicator_id")], _id("indicator", "indicator_id"), _id("event", "event_id"), "event-link", "关联红旗", "评分输入记录的事件—指标关联，不表示新增因果判断"))
        .unionByName(made(proven, ["event-evidence", c("event_id"), c("evidence_id")], _id("event", "event_id"), _id("evidence", "evidence_id"), "event-link", "事件来源", "评分输入记录的红旗事件证据"))
        .unionByName(made(spread, ["propagation", c("path_id")], _id("event", "event_id"), owner, "propagation", "风险传播", c("trace")))
    )


def counts(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Per company: nodes, edges, and edges of each kind of support and of propagation."""
    n = nodes_.groupBy("company_id").agg(F.count("*").alias("nodes"))
    kinds = {"direct_evidence": "direct", "inferred_evidence": "inferred", "background_evidence": "background", "propagation_paths": "propagation"}
    e = edges_.groupBy("company_id").agg(F.count("*").alias("edges"), *(F.count_if(F.col("kind") == k).alias(c) for c, k in kinds.items()))
    whole = n.join(e, "company_id", "left")
    return whole.select("company_id", "nodes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", *kinds)))


def _between(nodes_: DataFrame, edges_: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of some ids (company_id, id), and the edges that lie between them."""
    ids = ids.distinct()
    own = nodes_.join(ids, ["company_id", "id"], "left_semi")
    out = edges_
    for end in ("source", "target"):
        out = out.join(ids.withColumnRenamed("id", end), ["company_id", end], "left_semi")
    return own, out


def _ends(edges_: DataFrame) -> DataFrame:
    return edges_.select("company_id", F.explode(F.array("source", "target")).alias("id"))


def dimension_view(nodes_: DataFrame, edges_: DataFrame, dimension_id: str, expanded: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A dimension with its company, indicators and events; with the evidence at one expanded node, if it is named.

    An expanded node of another dimension shows nothing more; expanded evidence shows itself.
    """
    inside = F.array_contains("dimension_ids", dimension_id)
    shown = (F.col("kind") == "company") | ((F.col("kind") == "dimension") & (F.col("entity_id") == dimension_id)) | ((F.col("kind") != "evidence") & inside)
    ids = nodes_.where(shown).select("company_id", "id")
    if expanded is None:
        return _between(nodes_, edges_, ids)
    node = nodes_.where(F.col("id") == expanded)
    own = node.where(F.col("kind") == "evidence").select("company_id", "id")
    open_ = node.where((F.col("kind") != "evidence") & inside).select("company_id")
    touched = edges_.where((F.col("source") == expanded) | (F.col("target") == expanded)).join(open_, "company_id", "left_semi")
    evidence = F.col("source").startswith("evidence:") | F.col("target").startswith("evidence:")
    more = _ends(touched.where(evidence))
    some, between = _between(nodes_, edges_, ids.unionByName(own).unionByName(more))
    at = (F.col("source") == expanded) | (F.col("target") == expanded)
    return some, between.where(~evidence | at)


def overview(nodes_: DataFrame, edges_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies, dimensions and events, and the edges between them."""
    return _between(nodes_, edges_, nodes_.where(F.col("kind").isin("company", "dimension", "event")).select("company_id", "id"))


def lineage(nodes_: DataFrame, edges_: DataFrame, event_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Where a red flag comes from: its indicators, their dimensions and evidence, and its company. Without a name: each company's first event."""
    events = nodes_.where(F.col("kind") == "event")
    if event_id is None:
        start = events.groupBy("company_id").agg(F.min_by("id", F.struct("place", "id")).alias("start"))
    else:
        start = events.where(F.col("entity_id") == event_id).select("company_id", F.col("id").alias("start"))
    links = edges_.where(F.col("kind").isin("event-link", "propagation")).join(start, "company_id")
    first = _ends(links.where((F.col("source") == F.col("start")) | (F.col("target") == F.col("start"))))
    met = nodes_.where(F.col("kind") == "company").select("company_id", "id").unionByName(start.select("company_id", F.col("start").alias("id"))).unionByName(first).distinct()
    of = nodes_.where(F.col("kind").isin("indicator", "event")).join(met, ["company_id", "id"], "left_semi")
    dims = of.select("company_id", F.explode("dimension_ids").alias("dimension_id")).select("company_id", _id("dimension", "dimension_id").alias("id"))
    met = met.unionByName(dims).distinct()
    proof = edges_.where(F.col("kind").isin(EVIDENCE_KINDS)).join(met.withColumnRenamed("id", "source"), ["company_id", "source"], "left_semi")
    return _between(nodes_, edges_, met.unionByName(_ends(proof)))
