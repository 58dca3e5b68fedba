"""Views of companies: peer groups, base assessments, lenses, averages and the sets behind a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.numeric import half_up, index_level

# Peer groups that are compared together, and stock codes that make a group of their own.
MERGED_GROUPS = {"digital-chip": "chip-design", "analog-chip": "chip-design", "pharma": "chemical-pharma"}
CODE_GROUPS = {
    "semiconductor-equipment": ("688012", "688037", "688072"),
    "integrated-circuit-manufacturing": ("688347", "688981"),
}
GROUP_LABELS = {
    "chip-design": "芯片（数字+模拟芯片设计）", "chemical-pharma": "化学制剂", "semiconductor-equipment": "半导体设备", "integrated-circuit-manufacturing": "集成电路制造",
}
NO_GROUP, NO_LABEL = "unclassified", "未分类行业"
OFFICIAL = ("exchange", "filing", "official")


def benchmark_group(peer_group: Column, stock_code: Column) -> Column:
    """The group that a company is compared in: by peer group, else by stock code, else its own peer group."""
    out = None
    for peer, group in MERGED_GROUPS.items():
        out = F.when(peer_group == peer, group) if out is None else out.when(peer_group == peer, group)
    for group, codes in CODE_GROUPS.items():
        out = out.when(stock_code.isin(*codes), group)
    return F.coalesce(out, peer_group, F.lit(NO_GROUP))


def group_label(group: Column, segment: Column, industry: Column) -> Column:
    """The label of a benchmark group, else the company's segment, industry, or a default."""
    out = None
    for name, label in GROUP_LABELS.items():
        out = F.when(group == name, label) if out is None else out.when(group == name, label)
    return F.coalesce(out, F.nullif(segment, F.lit("")), F.nullif(industry, F.lit("")), F.lit(NO_LABEL))


def base_assessment(dimensions: DataFrame, narrative: DataFrame, totals: DataFrame, coverage: DataFrame, expected: int = 22) -> DataFrame:
    """One row per company: score, level, dimensions that have a score, availability and review status.

    dimensions: company_id, dimension_id, dimension_score; narrative: company_id, narrative_index (not
    in the score); totals: company_id, total_score; coverage: company_id, status. A company without a
    total has insufficient evidence, any other awaits review.
    """
    scored = dimensions.groupBy("company_id").agg(F.count("dimension_score").alias("_scored"))
    usable = coverage.groupBy("company_id").agg(F.count_if(~F.col("status").startswith("NA")).alias("_usable"))
    joined = totals.join(scored, "company_id", "left").join(narrative, "company_id", "left").join(usable, "company_id", "left")
    total = F.col("total_score")
    return joined.select(
        "company_id", total.alias("score"), index_level(total).alias("level"), "narrative_index",
        (F.coalesce("_scored", F.lit(0)) + F.col("narrative_index").isNotNull().cast("long")).alias("assessable_dimensions"),
        F.floor(F.coalesce("_usable", F.lit(0)) * 100.0 / expected + 0.5).cast("long").alias("indicator_availability"),
        F.when(total.isNull(), "insufficient-evidence").otherwise("manual-review").alias("review_status"),
    )


def risk_lens(assessed: DataFrame, least: float) -> DataFrame:
    """Companies with a score of `least` or more, best first; all of them where none has any score."""
    some = assessed.agg(F.coalesce(F.bool_or(F.col("score").isNotNull()), F.lit(False)).alias("_some"))
    joined = assessed.withColumn("_one", F.lit(1)).join(F.broadcast(some.withColumn("_one", F.lit(1))), "_one").drop("_one")
    kept = joined.where(~F.col("_some") | (F.col("score") >= least)).drop("_some")
    return kept.orderBy(F.col("score").desc_nulls_last(), "company_id")


def ordered_dimensions(dimensions: DataFrame) -> DataFrame:
    """Dimensions of each company with their place: highest score first, null last, then in name order."""
    w = Window.partitionBy("company_id").orderBy(F.col("dimension_score").desc_nulls_last(), "dimension_id")
    return dimensions.withColumn("place", F.row_number().over(w))


def indicator_averages(scores: DataFrame) -> DataFrame:
    """Mean score of each indicator over the companies that have one; 2 decimals."""
    by = scores.where("risk_score IS NOT NULL").groupBy("indicator_id").agg(F.avg("risk_score").alias("_mean"), F.count("*").alias("companies"))
    return by.select("indicator_id", "companies", half_up(F.col("_mean"), 2).alias("average"))


def company_sets(observations: DataFrame) -> DataFrame:
    """Number of distinct companies behind each source, indicator, and indicator with source.

    observations: company_id, indicator_id, source_id. One grouping-sets aggregate; null sources count as none.
    """
    own = observations.where("source_id IS NOT NULL").select("company_id", "indicator_id", "source_id").distinct()
    sets = own.groupingSets([["indicator_id"], ["source_id"], ["indicator_id", "source_id"]], "indicator_id", "source_id")
    return sets.agg(F.count_distinct("company_id").alias("companies"))


def kind_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges of a graph, counted by kind: element, kind, n."""
    a = nodes.groupBy("kind").agg(F.count("*").alias("n")).withColumn("element", F.lit("node"))
    b = edges.groupBy("kind").agg(F.count("*").alias("n")).withColumn("element", F.lit("edge"))
    return a.unionByName(b).select("element", "kind", "n")


def official(evidence: DataFrame) -> DataFrame:
    """Evidence of exchanges, filings and authorities."""
    return evidence.where(F.col("reliability").isin(*OFFICIAL))


def sources_with_observations(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """source_id and the observations that name it, as their source or among their further sources, each once and in order."""
    every = F.array_distinct(F.concat(F.array_compact(F.array("source_id")), F.coalesce("source_ids", F.array().cast("array<string>"))))
    links = observations.select("observation_id", F.explode(every).alias("source_id"))
    by = links.groupBy("source_id").agg(F.array_sort(F.collect_set("observation_id")).alias("observation_ids"))
    return sources.select("source_id").join(by, "source_id", "left").withColumn("observation_ids", F.coalesce("observation_ids", F.array().cast("array<string>")))
