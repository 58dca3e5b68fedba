"""Operators whose result depends on an order that a distributed table does not have by itself.

The input position of a row is its file and its number in it, which Parquet scans know; it travels
with the row, so "first seen", ties and distinct come out the same under any partitioning. Names are
ordered by Spark's collations, which know the rules of languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POSITION = "input_position"


def scanned(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files with their position: file, then row. The files' names order them."""
    df = spark.read.parquet(path)
    at = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*(columns or df.columns), at.alias(POSITION))


def first_seen(df: DataFrame, keys: list[str], position: str = POSITION) -> DataFrame:
    """The first row of each key by position; null keys are one. Combined before the shuffle, no window."""
    rest = [c for c in df.columns if c not in keys]
    least = df.groupBy(*keys).agg(F.min(F.struct(F.col(position), *[F.col(c) for c in rest if c != position])).alias("r"))
    return least.select(*keys, *[F.col(f"r.{c}") for c in rest])


def distinct_in_order(df: DataFrame, groups: list[str], value: str, into: str, position: str = POSITION) -> DataFrame:
    """Per group the distinct values, in the order in which each was first seen."""
    once = df.groupBy(*groups, value).agg(F.min(position).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("p", value)))
    return once.groupBy(*groups).agg(F.transform(ordered, lambda e: e[value]).alias(into))


def numbered(df: DataFrame, groups: list[str], order: list[Column], into: str = "place", position: str = POSITION) -> DataFrame:
    """Rows of each group numbered from 1 by an order, ties in the order of the input."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*groups).orderBy(*order, F.col(position))))


def locales(spark: SparkSession) -> set[str]:
    """Names of the collations of this Spark."""
    return {r["name"] for r in spark.sql("SELECT name FROM collations()").collect()}


def in_locale(c: Column, locale: str, known: set[str]) -> Column:
    """A text under the rules of a locale (zh, de, ...), or under those of its language or of no language where Spark lacks it."""
    for name in (locale, locale.split("_")[0], "UNICODE"):
        if name in known:
            return F.collate(c, name)
    return c


def locale_ranked(df: DataFrame, column: str, locale: str, groups: list[str], into: str = "place") -> DataFrame:
    """Rank of a text within its group in the order of a locale; what the locale holds for equal shares a rank. Nulls come last."""
    name = in_locale(F.col(column), locale, locales(df.sparkSession))
    return df.withColumn(into, F.rank().over(Window.partitionBy(*groups).orderBy(name.asc_nulls_last())))


def locale_distinct(df: DataFrame, column: str, locale: str, position: str) -> DataFrame:
    """One row for all texts that a locale holds for equal (de_CI: but for case), the first by position."""
    name = in_locale(F.col(column), locale, locales(df.sparkSession))
    rest = [c for c in df.columns if c != position]
    least = df.groupBy(name.alias("_name")).agg(F.min(F.struct(position, *rest)).alias("r"))
    return least.select(*[F.col(f"r.{c}") for c in [position, *rest]])
