"""Risk-analytics tables from the star-schema and event tables of a folder of Parquet files.

Companies are suppliers, observations are yearly aggregates of their lines, events are theirs by
user number. All aggregations are by supplier and year, with partial aggregation before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, rows: int, each: int, key: str) -> DataFrame:
    """df, which has so many rows, in partitions of about `each`: a small file is one partition, and all that is derived from its rows would be one task."""
    parts = math.ceil(rows / each)
    return df.repartition(parts, key) if parts > 1 else df  # a given number, which adaptive execution does not make less


def company_id(key: Column) -> Column:
    return F.concat(F.lit("star-"), F.lpad(key.cast("string"), 6, "0"))


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """company_id, s_suppkey, stock_code, short_name, peer_group_id, benchmark_group, acctbal."""
    s, n, r = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(
        company_id(F.col("s_suppkey")).alias("company_id"),
        "s_suppkey",
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"),
        F.col("s_name").alias("short_name"),
        F.col("n_name").alias("peer_group_id"),
        F.col("r_name").alias("benchmark_group"),
        F.col("s_acctbal").alias("acctbal"),
        "n_nationkey",
    )


def _long(df: DataFrame, metrics: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per metric with a value, from one column per metric."""
    rows = F.array(*(F.struct(F.lit(i).alias("indicator_id"), F.lit(m).alias("metric_name"), c.cast("double").alias("value")) for m, (i, c) in metrics.items()))
    return df.select("s_suppkey", "as_of_date", F.explode(rows).alias("r")).select("s_suppkey", "as_of_date", "r.*").where("value is not null")


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """observation_id, company_id, indicator_id, metric_name, as_of_date (text), numeric_value."""
    line = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_partkey", F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("long").alias("q"),
        (F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open"), (F.col("l_linenumber") == 1).alias("first"),
    )
    dated = lambda df: df.withColumn("y", F.year("day"))  # noqa: E731  what follows from a day is not shuffled with it
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand")
    owner = ["s_suppkey", "y"]
    # distinct parts and orders are counted by a level of their own, not by expanding every line; lines are dealt out by
    # part (and order) once, which serves this level and the join after it: few lines of a supplier's year share a part
    by_part = dated(line.drop("l_orderkey").repartition("l_partkey")).withColumn("m", F.month("day"))
    parts = by_part.groupBy(*owner, "l_partkey").agg(
        F.max("day").alias("last"), F.count("*").alias("n"), F.count_if("returned").alias("returned"), F.count_if("open").alias("open"),
        F.sum("q").alias("quantity"), F.bit_or(F.expr("shiftleft(1, m)")).alias("months"), F.count_if(F.col("m") == 12).alias("december"), F.count_if("first").alias("first_lines"),
    )
    orders = dated(line.select("s_suppkey", "l_orderkey", "day").repartition("l_orderkey")).groupBy(*owner, "l_orderkey").agg(F.lit(1).alias("_")).groupBy(*owner).agg(F.count("*").alias("orders"))
    by = parts.join(part, "l_partkey").groupBy(*owner).agg(
        F.max("last").alias("last"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum(F.when(F.col("p_type").startswith("PROMO"), F.col("n")).otherwise(0)).alias("promo"),
        F.sum("returned").alias("returned"), F.sum("open").alias("open"), F.sum("quantity").alias("quantity"), F.size(F.collect_set("p_brand")).alias("brands"),  # there are 25 brands
        F.bit_count(F.bit_or("months")).alias("months"), F.sum("december").alias("december"), F.sum("first_lines").alias("first_lines"),
    )
    years = Window.partitionBy("s_suppkey").orderBy("y")
    before = F.when(F.lag("y").over(years) == F.col("y") - 1, F.lag("quantity").over(years))
    by = by.join(orders, owner).withColumn("as_of_date", F.date_format("last", "yyyy-MM-dd")).withColumn("quantity_before", before)
    key = F.col("s_suppkey")
    yearly = _long(by, {
        "cnipa_core_operating_entity_valid_count": ("R05", F.when(key % 5 != 0, F.col("parts"))),
        "tyc_paid_patent_total_asof": ("R05", F.col("n")),
        "rd_personnel_ratio_pct": ("R06", F.lit(100.0) * F.col("promo") / F.col("n")),
        "fundraising_project_delay_event_count": ("R08", F.when((key % 3 != 0) & (key % 7 != 0), F.col("returned"))),
        "rd_negative_milestone_event_count": ("R08", F.when(key % 7 != 0, F.col("open"))),
        "revenue_growth_pct": ("R13", F.lit(100.0) * (F.col("quantity") - F.col("quantity_before")) / F.nullif("quantity_before", F.lit(0))),
        "ocf_short_debt_coverage": ("R16", F.col("quantity").cast("double") / F.col("orders")),
        "tyc_paid_supplier_domestic_profile_count": ("R17", F.col("brands")),
        "us_csl_distinct_list_hit_count": ("R19", F.col("december")),
        "eu_fsd_exact_name_hit_count": ("R19", F.when(key % 2 == 0, F.col("first_lines"))),
        "core_tech_departure_event_count": ("R22", F.lit(12) - F.col("months")),
    })
    shares = _long(_customers(spark, folder, line.select("s_suppkey", "l_orderkey", "day", "q")), {
        "overseas_revenue_ratio_pct": ("R18", F.lit(100.0) * F.col("abroad") / F.col("n")),
        "maximum_controller_ratio_pct": ("R20", F.lit(100.0) * F.col("most") / F.nullif("quantity", F.lit(0))),
    })
    counted = _long(_event_counts(spark, folder), {
        "tyc_paid_admin_penalty_total_asof": ("R10", F.col("errors")),
        "exchange_inquiry_topic_count": ("R11", F.col("signups")),
    })
    every = yearly.unionByName(shares).unionByName(counted)
    return every.select(
        F.concat_ws(":", F.lit("observation"), "s_suppkey", "metric_name", "as_of_date").alias("observation_id"),
        company_id(key).alias("company_id"), "indicator_id", "metric_name", "as_of_date", F.col("value").alias("numeric_value"),
    )


def _customers(spark: SparkSession, folder: str, line: DataFrame) -> DataFrame:
    """Per supplier and year: lines to other regions, and the quantity of the largest customer."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).where("c_custkey IS NOT NULL")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    home = table(spark, folder, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("home"))
    buyer = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("away"))
    # dealt out by customer before they are summed: the join with the customers needs them so, and few lines of a supplier's year share one
    bought = line.join(orders, "l_orderkey").select("s_suppkey", "day", "q", "c_custkey").repartition("c_custkey")
    sold = bought.withColumn("y", F.year("day")).groupBy("s_suppkey", "y", "c_custkey").agg(
        F.sum("q").alias("q"), F.count("*").alias("n"), F.max("day").alias("last")
    )
    placed = sold.join(buyer, "c_custkey").join(home, "s_suppkey")
    by = placed.groupBy("s_suppkey", "y").agg(
        F.max("last").alias("last"), F.sum(F.when(F.col("home") != F.col("away"), F.col("n")).otherwise(0)).alias("abroad"),
        F.sum("n").alias("n"), F.max("q").alias("most"), F.sum("q").alias("quantity"),
    )
    return by.withColumn("as_of_date", F.date_format("last", "yyyy-MM-dd"))


def supplier_count(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "supplier").count()


def events(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, company_id, kind, event_date, title, confidence of the four kinds of events."""
    n = supplier_count(spark, folder)
    kinds = F.create_map(*(F.lit(x) for pair in (("error", "screening"), ("signup", "inquiry"), ("purchase", "deep-search"), ("view", "litigation")) for x in pair))
    e = table(spark, folder, "events").where(F.col("event_type").isin("error", "signup", "purchase", "view"))
    return e.select(
        F.col("event_id").cast("long").alias("event_id"),
        company_id(F.col("user_id") % n).alias("company_id"),
        F.try_element_at(kinds, F.col("event_type")).alias("kind"),
        F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd").alias("event_date"),
        F.concat_ws(" ", "event_type", F.lit("user"), "user_id").alias("title"),
        F.col("value").alias("value"),
    )


def _event_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder).withColumn("s_suppkey", F.expr("cast(substring(company_id, 6) as long)"))
    by = e.groupBy("s_suppkey", F.substring("event_date", 1, 4).alias("y")).agg(
        F.max("event_date").alias("as_of_date"), F.count_if(F.col("kind") == "screening").alias("errors"), F.count_if(F.col("kind") == "inquiry").alias("signups")
    )
    return by
