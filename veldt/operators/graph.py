"""Property graphs of companies, indicators, sources and events: building and selecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.functions.numeric import half_up, tone


def nodes(companies: DataFrame, totals: DataFrame, scores: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """id, kind, label, score: companies, categories, indicators, sources and events."""
    mean = lambda key: scores.where("risk_score is not null").groupBy(key).agg(half_up(F.avg("risk_score"), 2).alias("score"))
    company = companies.join(totals, "company_id", "left").select(
        F.concat(F.lit("company:"), "company_id").alias("id"), F.lit("company").alias("kind"), F.col("short_name").alias("label"), F.col("total_score").alias("score")
    )
    category = mean("dimension_id").select(F.concat(F.lit("category:"), "dimension_id").alias("id"), F.lit("category").alias("kind"), F.col("dimension_id").alias("label"), "score")
    indicator = mean("indicator_id").select(F.concat(F.lit("indicator:"), "indicator_id").alias("id"), F.lit("indicator").alias("kind"), F.col("indicator_id").alias("label"), "score")
    none = F.lit(None).cast("double").alias("score")
    source = sources.select(F.concat(F.lit("source:"), "source_id").alias("id"), F.lit("source").alias("kind"), F.col("source_id").alias("label"), none)
    event = events.select(F.concat(F.lit("event:"), "event_id").alias("id"), F.lit("event").alias("kind"), F.col("title").alias("label"), none)
    every = company.unionByName(category).unionByName(indicator).unionByName(source).unionByName(event)
    return every.withColumn("tone", tone(F.col("score")))


def edges(companies: DataFrame, scores: DataFrame, observations: DataFrame, events: DataFrame) -> DataFrame:
    """source, target, kind, n: company-category, category-indicator, indicator-source and company-event."""
    one = F.lit(1).cast("long").alias("n")
    category = scores.select("dimension_id").distinct()
    owns = companies.select("company_id").join(F.broadcast(category), F.lit(True)).select(  # at most six categories
        F.concat(F.lit("company:"), "company_id").alias("source"), F.concat(F.lit("category:"), "dimension_id").alias("target"), F.lit("structure").alias("kind"), one
    )
    holds = scores.select("dimension_id", "indicator_id").distinct().select(
        F.concat(F.lit("category:"), "dimension_id").alias("source"), F.concat(F.lit("indicator:"), "indicator_id").alias("target"), F.lit("structure").alias("kind"), one
    )
    proof = observations.where("source_id is not null").groupBy("indicator_id", "source_id").agg(F.count_distinct("company_id").alias("n"))
    proven = proof.select(F.concat(F.lit("indicator:"), "indicator_id").alias("source"), F.concat(F.lit("source:"), "source_id").alias("target"), F.lit("evidence").alias("kind"), "n")
    met = events.select(F.concat(F.lit("company:"), "company_id").alias("source"), F.concat(F.lit("event:"), "event_id").alias("target"), F.lit("event").alias("kind"), one)
    return owns.unionByName(holds).unionByName(proven).unionByName(met)


def degrees(edges_: DataFrame) -> DataFrame:
    """Edges at each node; a loop counts once."""
    ends = F.explode(F.array_distinct(F.array("source", "target"))).alias("id")
    return edges_.select(ends).groupBy("id").agg(F.count("*").alias("degree"))


def ego(nodes_: DataFrame, edges_: DataFrame, start: str) -> tuple[DataFrame, DataFrame]:
    """The edges at a node, and the nodes they end in."""
    own = edges_.where((F.col("source") == start) | (F.col("target") == start))
    ends = own.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes_.join(ends, "id", "left_semi"), own


def hops(edges_: DataFrame, start: DataFrame, kinds: list[str]) -> DataFrame:
    """id, hop: nodes met from the start nodes along edges of one kind a hop, the least hop of each."""
    reached = start.select("id", F.lit(0).alias("hop"))
    edge = reached
    for i, kind in enumerate(kinds, 1):
        step = edges_.where(F.col("kind") == kind)
        edge = edge.join(step, edge["id"] == step["source"]).select(F.col("target").alias("id"), F.lit(i).alias("hop")).distinct()
        reached = reached.unionByName(edge)
    return reached.groupBy("id").agg(F.min("hop").alias("hop"))


def of_kinds(nodes_: DataFrame, edges_: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of some kinds and the edges between them."""
    own = nodes_.where(F.col("kind").isin(kinds))
    a, b = own.select(F.col("id").alias("source")), own.select(F.col("id").alias("target"))
    return own, edges_.join(a, "source", "left_semi").join(b, "target", "left_semi")


def category_means(scores: DataFrame) -> DataFrame:
    """Unweighted mean of the indicator scores of each company and category."""
    return scores.where("risk_score is not null").groupBy("company_id", "dimension_id").agg(half_up(F.avg("risk_score"), 2).alias("category_score"))
