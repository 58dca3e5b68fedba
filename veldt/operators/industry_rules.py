"""Rules of a whole industry dataset: those of its tables, of what they say about each other, and of their publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.functions.text import local_path
from veldt.operators.validate import all_of, check, industry_violations, references, unique

SCHEMA_VERSION = "industry-risk-v1"
INDICATORS = [f"R{i:02d}" for i in range(1, 23)]


def _differs(meta: DataFrame, df: DataFrame, column: str, rule: str) -> DataFrame:
    """Whether the rows of a table are as many as the metadata says; one row against one row."""
    n = df.agg(F.count("*").alias("n"))
    return meta.crossJoin(F.broadcast(n)).where(~F.col(column).eqNullSafe(F.col("n"))).select(F.lit(rule).alias("rule"), F.concat_ws("|", F.col(column), F.col("n")).alias("entity"))


def _named(df: DataFrame, arrays: str, identity: str, value: str) -> DataFrame:
    return df.select(identity, F.explode(arrays).alias(value))


def leaks(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows that name a path of somebody's machine in any text column: table and identity."""
    parts = []
    for name, (df, identity) in tables.items():
        texts = [F.col(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
        hit = reduce(lambda a, b: a | b, [F.coalesce(local_path(c), F.lit(False)) for c in texts], F.lit(False))
        parts.append(df.where(hit).select(F.lit("local-path").alias("rule"), F.concat(F.lit(f"{name}|"), identity.cast("string")).alias("entity")))
    return all_of(*parts)


def dataset_violations(
    meta: DataFrame, companies: DataFrame, indicators: DataFrame, observations: DataFrame, coverage: DataFrame, sources: DataFrame, groups: DataFrame, supplements: DataFrame, events: DataFrame
) -> DataFrame:
    """rule, entity of everything that is wrong with a dataset.

    meta: one row of schema_version, sample_size, indicator_count. observations may lack a number if they have a text or a
    status. groups: group_id, company_ids (array). Null references of optional kinds (peer group, source of a supplement) are none.
    """
    o = observations
    silent = F.col("text_value").isNull() & (F.trim(F.coalesce("status", F.lit(""))) == "")
    tables = industry_violations(companies, indicators, o.withColumn("numeric_value", F.when(~silent, F.lit(0.0)).otherwise(F.col("numeric_value"))), coverage, sources)
    have = indicators.agg(F.collect_set(F.when(F.col("indicator_id").isin(INDICATORS), F.col("indicator_id"))).alias("have"))  # at most 22
    absent = have.select(F.lit("missing-indicator").alias("rule"), F.explode(F.array_except(F.array(*map(F.lit, INDICATORS)), F.col("have"))).alias("entity"))
    return all_of(
        tables,
        check(meta, ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "schema-version", "schema_version"),
        _differs(meta, companies, "sample_size", "sample-size"),
        _differs(meta, indicators, "indicator_count", "indicator-count"),
        unique(sources, ["source_id"], "duplicate-source"),
        absent,
        references(_named(o, "source_ids", "observation_id", "linked"), "linked", sources, "source_id", "observation-linked-source", "observation_id"),
        unique(groups, ["group_id"], "duplicate-group"),
        references(companies.where("peer_group_id IS NOT NULL"), "peer_group_id", groups, "group_id", "company-group", "company_id"),
        references(_named(groups, "company_ids", "group_id", "member"), "member", companies, "company_id", "group-member", "group_id"),
        references(supplements, "company_id", companies, "company_id", "supplement-company", "supplement_id"),
        references(supplements.where("source_id IS NOT NULL"), "source_id", sources, "source_id", "supplement-source", "supplement_id"),
        references(events, "company_id", companies, "company_id", "event-company", "event_id"),
        leaks({"company": (companies, F.col("company_id")), "observation": (o, F.col("observation_id")), "source": (sources, F.col("source_id")), "event": (events, F.col("event_id"))}),
    )
