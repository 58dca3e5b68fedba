"""Serving queries: top-k, ranking, comparison, feeds, search, grouping and export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.dates import months_before
from veldt.functions.text import csv_field, searched


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "k") -> DataFrame:
    """The first k rows of each key; the limit is pushed below the shuffle as a group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def peer_ranking(totals: DataFrame) -> DataFrame:
    """Place of each company in its group: score descending (null last), coverage descending, id."""
    w = Window.partitionBy("benchmark_group").orderBy(F.coalesce("total_score", F.lit(-1.0)).desc(), F.col("scored").desc(), "company_id")
    return totals.withColumn("place", F.row_number().over(w))


def next_peer(companies: DataFrame) -> DataFrame:
    """The company behind each in its group, the first behind the last."""
    order = Window.partitionBy("benchmark_group").orderBy("company_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = F.coalesce(F.lead("company_id").over(order), F.first("company_id").over(whole))
    return companies.select("company_id", "benchmark_group", follow.alias("next_company_id"))


def compare(dimensions: DataFrame, left: str, right: str) -> DataFrame:
    """Dimensions of one company beside those of another."""
    a = dimensions.where(F.col("company_id") == left).select("dimension_id", F.col("dimension_score").alias("left_score"))
    b = dimensions.where(F.col("company_id") == right).select("dimension_id", F.col("dimension_score").alias("right_score"))
    return a.join(b, "dimension_id", "left").withColumn("gap", F.round(F.col("left_score") - F.col("right_score"), 2))


def event_register(events: DataFrame, severity: str | None = None, status: str | None = None, wanted: str | None = None) -> DataFrame:
    """Events by severity, status and a text in any of four fields; newest first."""
    tests = []
    if severity:
        tests.append(F.col("severity") == severity)
    if status:
        tests.append(F.col("status") == status)
    if wanted:
        tests.append(searched([F.col(c) for c in ("title", "kind", "company_id", "event_date")], wanted))
    found = events.where(reduce(lambda a, b: a & b, tests)) if tests else events
    return found.orderBy(F.coalesce("event_date", F.lit("")).desc(), "event_id")


def recent(events: DataFrame, snapshot: str, months: int) -> DataFrame:
    """Events of the last months before a snapshot day; a day that the first month lacks runs over into the next."""
    since = months_before(F.lit(snapshot), months).cast("string")
    return events.where((F.col("event_date") >= since) & (F.col("event_date") <= snapshot))


def monthly_trend(events: DataFrame, snapshot: str, months: int = 6) -> DataFrame:
    """High, medium and all events of each of the last months, months without events included."""
    spark = events.sparkSession
    first = F.add_months(F.trunc(F.lit(snapshot).cast("date"), "month"), 1 - months)
    spine = spark.range(1).select(F.explode(F.sequence(first, F.lit(snapshot).cast("date"), F.expr("interval 1 month"))).alias("d"))
    spine = spine.select(F.date_format("d", "yyyy-MM").alias("month"))
    by = events.groupBy(F.substring("event_date", 1, 7).alias("month")).agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"), F.count("*").alias("total")
    )
    joined = spine.join(by, "month", "left")
    return joined.select("month", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("high", "medium", "total")])


def feed(signals: DataFrame, wanted: str | None = None, category: str | None = None, verified: str | None = None, since: str | None = None, limit: int = 18) -> DataFrame:
    """The first page of signals: filtered, newest first."""
    found = signals
    if category:
        found = found.where(F.col("category") == category)
    if verified:
        found = found.where(F.col("verification") == verified)
    if since:
        found = found.where(F.col("event_date") >= since)
    if wanted:
        found = found.where(searched([F.col(c) for c in ("title", "short_name", "company_id", "category", "event_date")], wanted))
    return found.orderBy(F.col("event_date").desc(), "event_id").limit(limit)


def csv_lines(df: DataFrame) -> DataFrame:
    """One quoted line per row, safe for spreadsheets; fields in column order."""
    return df.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in df.columns]).alias("line"))


def write_csv(sections: list[tuple[str, DataFrame]], folder: str) -> None:
    """One folder of lines per section, a header and a byte-order mark first."""
    for name, df in sections:
        head = df.sparkSession.createDataFrame([("﻿" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns),)], "line string")
        head.withColumn("_k", F.lit(0)).unionByName(csv_lines(df).withColumn("_k", F.lit(1))).orderBy("_k").select("line").write.mode("overwrite").text(f"{folder}/{name}")


def status_summary(events: DataFrame) -> DataFrame:
    """Events of each company by status, and the share that is done, in whole percent."""
    done, n = F.count_if(F.col("status") == "done"), F.count("*")
    return events.groupBy("company_id").agg(
        n.alias("events"), done.alias("done"), F.count_if(F.col("status") == "open").alias("open"), F.floor(100 * done / n + 0.5).alias("response_rate")
    )


def coverage_summary(coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and usable rows of a coverage table by some keys; a status NA.. is not usable."""
    return coverage.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(~F.col("status").startswith("NA")).alias("usable"))


def directory(groups: DataFrame, companies: DataFrame) -> DataFrame:
    """Every peer group with the number of its companies and of those flagged; companies are counted before they are joined.

    groups: peer_group_id and what describes it; companies: company_id, peer_group_id, flagged.
    """
    by = companies.groupBy("peer_group_id").agg(F.count("company_id").alias("companies"), F.count_if("flagged").alias("flagged"))
    joined = groups.join(by, "peer_group_id", "left")
    return joined.select(*groups.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("companies", "flagged")])
