"""Integrity rules as tables of violations: (rule, entity). A sound dataset gives an empty table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _violation(df: DataFrame, rule: str, entity: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"))


def unique(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1")
    return _violation(twice, rule, F.concat_ws("|", *keys))


def not_empty(df: DataFrame, column: str, rule: str, entity: str) -> DataFrame:
    return _violation(df.where(F.length(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))) == 0), rule, F.coalesce(F.col(entity), F.lit("")))


def references(df: DataFrame, column: str, target: DataFrame, target_column: str, rule: str, entity: str) -> DataFrame:
    """Rows whose reference is set but leads nowhere."""
    known = target.select(F.col(target_column).alias(column)).distinct()
    return _violation(df.where(F.col(column).isNotNull()).join(known, column, "left_anti"), rule, F.col(entity))


def polymorphic(df: DataFrame, targets: dict[str, tuple[DataFrame, str]], rule: str, entity: str) -> DataFrame:
    """References by (target_type, target_id) into one of several tables."""
    known = reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(k).alias("target_type"), F.col(c).alias("target_id")) for k, (t, c) in targets.items()])
    return _violation(df.join(known.distinct(), ["target_type", "target_id"], "left_anti"), rule, F.col(entity))


def check(df: DataFrame, bad: Column, rule: str, entity: str) -> DataFrame:
    return _violation(df.where(F.coalesce(bad, F.lit(False))), rule, F.col(entity))


def complete(rows: DataFrame, left: DataFrame, right: DataFrame, keys: tuple[str, str], rule: str) -> DataFrame:
    """Pairs of the product of two key tables that have no row; the right one is small and broadcast."""
    pairs = left.select(keys[0]).distinct().join(F.broadcast(right.select(keys[1]).distinct()), F.lit(True))
    return _violation(pairs.join(rows.select(*keys), list(keys), "left_anti"), rule, F.concat_ws("|", *keys))


def set_equal(expected: DataFrame, observed: DataFrame, column: str, rule: str) -> DataFrame:
    a, b = expected.select(column).distinct(), observed.select(column).distinct()
    return _violation(a.join(b, column, "left_anti"), f"{rule}:missing", F.col(column)).unionByName(
        _violation(b.join(a, column, "left_anti"), f"{rule}:unexpected", F.col(column))
    )


def all_of(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def industry_violations(companies: DataFrame, indicators: DataFrame, observations: DataFrame, coverage: DataFrame, sources: DataFrame) -> DataFrame:
    """The rules of an industry dataset, over companies, indicators, observations, coverage and sources."""
    o = observations
    return all_of(
        unique(companies, ["company_id"], "duplicate-company"),
        unique(indicators, ["indicator_id"], "duplicate-indicator"),
        unique(o, ["observation_id"], "duplicate-observation"),
        unique(o, ["company_id", "indicator_id", "metric_name", "as_of_date"], "duplicate-observation-key"),
        unique(coverage, ["company_id", "indicator_id"], "duplicate-coverage"),
        check(indicators, ~F.col("indicator_id").rlike("^R(0[1-9]|1[0-9]|2[0-2])$"), "unknown-indicator-id", "indicator_id"),
        check(indicators, F.col("kind") != F.when(F.col("indicator_id") <= "R04", "narrative").otherwise("weighted"), "wrong-kind", "indicator_id"),
        references(o, "company_id", companies, "company_id", "observation-company", "observation_id"),
        references(o, "indicator_id", indicators, "indicator_id", "observation-indicator", "observation_id"),
        references(o, "source_id", sources, "source_id", "observation-source", "observation_id"),
        check(o, F.col("numeric_value").isNull(), "observation-without-value", "observation_id"),
        check(o, ~F.col("confidence").between(0, 1), "observation-confidence", "observation_id"),
        references(coverage, "company_id", companies, "company_id", "coverage-company", "company_id"),
        references(coverage, "indicator_id", indicators, "indicator_id", "coverage-indicator", "company_id"),
        complete(coverage, companies, indicators, ("company_id", "indicator_id"), "coverage-absent"),
    )
