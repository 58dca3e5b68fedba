"""Peer scoring: latest values, candidate fallback, tie-averaged percentiles, objective weights.

Everything is in long form: one row per company and indicator. No table is joined with itself by
peer group; percentiles come from counts of distinct values, added up over ranges of values within a
group, and weights from sums per group and pair of indicators, of which there are at most 153 a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.numeric import clamp, finite, half_up
from veldt.plans.catalogue import COMPOSITE, COMPOSITE_PARTS, DIMENSIONS
from veldt.sources.snapshots import written

ANCHOR, ALPHA, BETA = 0.5, 0.5, 0.5


def latest(observations: DataFrame) -> DataFrame:
    """The newest finite value of each company and metric: date descending, then id descending."""
    newest = F.max(F.struct(F.coalesce("as_of_date", F.lit("")).alias("as_of_date"), "observation_id", "numeric_value"))
    by = observations.where(finite(F.col("numeric_value"))).groupBy("company_id", "metric_name").agg(newest.alias("r"))
    return by.select("company_id", "metric_name", "r.as_of_date", "r.observation_id", "r.numeric_value")


def with_composite(newest: DataFrame, name: str = COMPOSITE, parts: list[str] = COMPOSITE_PARTS) -> DataFrame:
    """Add the sum of the parts that a company has; its date and id are those of the first part it has."""
    rank = F.array_position(F.array(*map(F.lit, parts)), F.col("metric_name"))
    first = F.min(F.struct(rank.alias("k"), "as_of_date", "observation_id"))
    own = newest.where(F.col("metric_name").isin(parts)).groupBy("company_id")
    total = own.agg(F.sum("numeric_value").alias("numeric_value"), first.alias("f"))
    added = total.select("company_id", F.lit(name).alias("metric_name"), "f.as_of_date", "f.observation_id", "numeric_value")
    return newest.unionByName(added)


def resolved(newest: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first candidate metric of each company and indicator that has a value."""
    found = newest.join(F.broadcast(candidates), "metric_name")
    best = F.min(F.struct("rank", "metric_name", "comparable_group", "dimension_id", "direction", "numeric_value"))
    return found.groupBy("company_id", "indicator_id").agg(best.alias("r")).select("company_id", "indicator_id", "r.*")


def tie_percentile(value: Column, group: list[str]) -> tuple[Column, Column]:
    """Percent rank with ties at their middle, 4 decimals, null for a single value; and the sample size.

    A window holds a whole group; groups that may be large want `ranged_percentiles`.
    """
    n = F.count("*").over(Window.partitionBy(*group))
    below = F.rank().over(Window.partitionBy(*group).orderBy(value)) - 1
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return half_up(F.when(n > 1, (below + (ties - 1) / 2.0) / (n - 1)), 4), n


#: Ranges of values to each doubling, and a number above all that a range of doubles can have.
STEPS, ABOVE = 64, 70000


def value_range(v: Column) -> Column:
    """A whole number that never falls as v grows: 64 steps to each doubling of its size, on either side of zero.

    It depends on v alone (log2 is computed alike on all machines), so that every reading of a table finds the same ranges.
    """
    step = F.floor(F.log2(F.abs(v)) * STEPS) + ABOVE
    return F.when(v > 0, step).when(v < 0, -step).otherwise(F.lit(0)).cast("int")


def ranged_percentiles(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """df with sample_size and risk_percentile as of tie_percentile, however large a group is.

    Equal values are counted before anything is shuffled, so a value that a third of all rows share is one row. Counts of
    ranges are added up within a group (a few thousand rows at most for values of common sizes), counts of distinct
    values only within their range, and the sums are joined back by value. Rows without a key or a value have neither column.
    """
    v = (F.col(value) + 0.0).alias("v")  # no negative zero
    distinct = df.groupBy(*keys, v).agg(F.count("*").alias("ties")).where(F.col("v").isNotNull()).withColumn("value_range", value_range(F.col("v")))
    group, earlier = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    counts = distinct.groupBy(*keys, "value_range").agg(F.sum("ties").alias("rows"))
    before = F.coalesce(F.sum("rows").over(group.orderBy("value_range").rowsBetween(*earlier)), F.lit(0))
    starts = counts.select(*keys, "value_range", before.alias("before"), F.sum("rows").over(group).alias("sample_size"))
    inside = F.coalesce(F.sum("ties").over(Window.partitionBy(*keys, "value_range").orderBy("v").rowsBetween(*earlier)), F.lit(0))
    placed = distinct.withColumn("inside", inside).join(starts, [*keys, "value_range"])
    n, below = F.col("sample_size"), F.col("before") + F.col("inside")
    percentile = half_up(F.when(n > 1, (below + (F.col("ties") - 1) / 2.0) / (n - 1)), 4)
    found = placed.select(*keys, "v", "sample_size", percentile.alias("risk_percentile"))
    return df.withColumn("v", v).join(found, [*keys, "v"], "left").drop("v")


def anchor_score(percentile: Column, anchor: float = ANCHOR, alpha: float = ALPHA, beta: float = BETA) -> Column:
    a, b = alpha / (alpha + beta), beta / (alpha + beta)
    return half_up(100.0 * clamp(a * anchor + b * percentile, 0, 1), 2)


def peer_scores(values: DataFrame, companies: DataFrame) -> DataFrame:
    """Score of each company and indicator among the companies of its benchmark group."""
    grouped = values.join(companies.select("company_id", "benchmark_group"), "company_id")
    risk = F.when(F.col("direction") == "down", -F.col("numeric_value")).otherwise(F.col("numeric_value"))
    keys = ["benchmark_group", "indicator_id", "comparable_group"]
    out = ranged_percentiles(grouped.withColumn("risk_value", risk), "risk_value", keys)
    out = out.withColumn("risk_score", anchor_score(F.col("risk_percentile")))
    status = F.when(F.col("risk_score").isNull(), "missing").otherwise("scored")
    return out.withColumn("status", status).withColumn("centered", F.col("risk_score") - 50.0).select(
        "company_id", "benchmark_group", "indicator_id", "dimension_id", "metric_name", "comparable_group", "numeric_value",
        "sample_size", "risk_percentile", "risk_score", "centered", "status",
    )


def quantiles(values: DataFrame, keys: list[str], value: str = "numeric_value") -> DataFrame:
    """Count, 5th, 50th and 95th percentile, linearly interpolated."""
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    by = values.where(finite(F.col(value))).groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q"))
    return by.select(*keys, "n", F.col("q")[0].alias("p05"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p95"))


def historical_anchor(stats: DataFrame) -> Column:
    """(median - p05) / (p95 - p05) in 0..1, 4 decimals; null for fewer than 3 values or no range."""
    span = F.col("p95") - F.col("p05")
    return F.when((F.col("n") >= 3) & (span != 0), half_up(clamp(F.try_divide(F.col("median") - F.col("p05"), span), 0, 1), 4))


def full_score(anchor: Column, percentile: Column, beta: float = BETA) -> Column:
    """Score from a company's own anchor and its percentile; null without an anchor."""
    return half_up(100.0 * clamp((1 - beta) * anchor + beta * percentile, 0, 1), 2)


def _active(matrix: DataFrame) -> DataFrame:
    """benchmark_group, column, n, mean, std of the columns with two values or more."""
    stats = matrix.groupBy("benchmark_group", "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.where("n >= 2")


def correlations(matrix: DataFrame) -> DataFrame:
    """Pairwise-complete Pearson correlation of the columns of each group; 0 where it has no meaning.

    matrix: benchmark_group, company_id, column, x. One row for each ordered pair (a, b). A company's
    columns, of which there are few, come together in one row that yields its pairs, and these are
    summed once: moments about 1/2, the middle of the values. A variance under 1e-11 of its second
    moment is rounding.
    """
    value = F.struct(F.col("column").alias("c"), (F.col("x") - 0.5).alias("v"))
    rows = matrix.where("x is not null").groupBy("benchmark_group", "company_id").agg(F.collect_list(value).alias("r"))
    second = lambda p: F.transform(F.filter("r", lambda q: p["c"] < q["c"]), lambda q: F.struct(p["c"].alias("a"), q["c"].alias("b"), p["v"].alias("x"), q["v"].alias("y")))
    pairs = rows.select("benchmark_group", F.inline(F.flatten(F.transform("r", second))))
    x, y = F.col("x"), F.col("y")
    sums = pairs.groupBy("benchmark_group", "a", "b").agg(
        F.count("*").alias("pairs"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")
    )

    def centred(product: str, one: str, other: str) -> Column:
        return F.col(product) - F.col(one) * F.col(other) / F.col("pairs")

    vx, vy = centred("xx", "sx", "sx"), centred("yy", "sy", "sy")
    flat = (F.col("pairs") < 2) | (vx <= 1e-11 * F.col("xx")) | (vy <= 1e-11 * F.col("yy"))
    rho = F.when(flat, 0.0).otherwise(centred("xy", "sx", "sy") / F.sqrt(F.abs(vx) * F.abs(vy)))
    once = sums.select("benchmark_group", "a", "b", "pairs", rho.alias("rho"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return once.select("benchmark_group", F.explode(both).alias("p"), "pairs", "rho").select("benchmark_group", "p.a", "p.b", "pairs", "rho")


def critic_information(matrix: DataFrame) -> DataFrame:
    """std * sum over the other active columns of 1 - |correlation|."""
    active = _active(matrix).select("benchmark_group", "column", "std")
    a = active.select("benchmark_group", F.col("column").alias("a"), "std")
    b = active.select("benchmark_group", F.col("column").alias("b"))
    every = a.join(b, "benchmark_group").where("a <> b").join(correlations(matrix), ["benchmark_group", "a", "b"], "left")
    conflict = every.groupBy("benchmark_group", "a").agg(F.sum(1 - F.abs(F.coalesce("rho", F.lit(0.0)))).alias("conflict"))
    info = active.join(conflict.withColumnRenamed("a", "column"), ["benchmark_group", "column"], "left")
    return info.select("benchmark_group", "column", (F.col("std") * F.coalesce("conflict", F.lit(0.0))).alias("information"))


def entropy_information(matrix: DataFrame) -> DataFrame:
    """max(0, 1 + sum p ln p / ln n) of the active columns."""
    active = _active(matrix).select("benchmark_group", "column", "n")
    v = matrix.where("x is not null").select("benchmark_group", "column", (F.greatest(F.col("x"), F.lit(0.0)) + 1e-12).alias("v"))
    totals = v.groupBy("benchmark_group", "column").agg(F.sum("v").alias("total"))
    p = v.join(totals, ["benchmark_group", "column"]).join(active, ["benchmark_group", "column"]).withColumn("p", F.col("v") / F.col("total"))
    h = p.groupBy("benchmark_group", "column").agg((F.sum(F.col("p") * F.ln("p")) / F.ln(F.max("n"))).alias("h"))
    return h.select("benchmark_group", "column", F.greatest(F.lit(0.0), 1 + F.col("h")).alias("information"))


def normalised(information: DataFrame) -> DataFrame:
    """Weights that add up to one in each group, 6 decimals; equal if there is no information."""
    group = Window.partitionBy("benchmark_group")
    clipped = F.greatest(F.col("information"), F.lit(0.0))
    total = F.sum(clipped).over(group)
    weight = F.when(total > 0, F.try_divide(clipped, total)).otherwise(1.0 / F.count("*").over(group))
    return information.select("benchmark_group", "column", half_up(weight, 6).alias("weight"))


def objective_weights(matrix: DataFrame, method: str) -> DataFrame:
    """Weights of the columns of each group by "critic" or "entropy".

    matrix: benchmark_group, company_id, column, x (0..1 or null). A column with fewer than two
    values has no weight, and a group of one company gets none at all.
    """
    rows = matrix.where("x is not null")
    return normalised(critic_information(rows) if method == "critic" else entropy_information(rows))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of the values weighted where weights are positive, else the plain mean; 2 decimals."""
    counts = F.col(value).isNotNull() & (F.col(weight) > 0)
    total = F.sum(F.when(counts, F.col(weight)))
    by_weight = F.sum(F.when(counts, F.col(weight) * F.col(value)))
    return half_up(F.coalesce(F.try_divide(by_weight, total), F.avg(value)), 2)


def dimension_scores(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """company_id, benchmark_group, dimension_id, dimension_score over the weighted indicators."""
    own = scores.where("dimension_id <> 'narrative' and risk_score is not null")
    w = weights.withColumnRenamed("column", "indicator_id")
    joined = own.join(w, ["benchmark_group", "indicator_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return joined.groupBy("company_id", "benchmark_group", "dimension_id").agg(weighted_mean("risk_score", "weight").alias("dimension_score"))


def method_results(scores: DataFrame, method: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Indicator weights, dimension scores, dimension weights and total scores of one method."""
    matrix = scores.where("dimension_id <> 'narrative'").select(
        "benchmark_group", "company_id", F.col("indicator_id").alias("column"), (F.col("risk_score") / 100.0).alias("x")
    )
    first = objective_weights(matrix, method)
    dims = written(dimension_scores(scores, first), f"dimension_scores-{method}")  # read by the second stage and by the totals
    second_matrix = dims.select("benchmark_group", "company_id", F.col("dimension_id").alias("column"), (F.col("dimension_score") / 100.0).alias("x"))
    second = objective_weights(second_matrix, method)
    w = second.withColumnRenamed("column", "dimension_id")
    joined = dims.join(w, ["benchmark_group", "dimension_id"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = joined.groupBy("company_id", "benchmark_group").agg(
        weighted_mean("dimension_score", "weight").alias("total_score"), F.count("dimension_score").alias("dimensions_scored")
    )
    return first, dims, second, totals


def narrative_index(scores: DataFrame) -> DataFrame:
    """Plain mean of the scored narrative indicators, 2 decimals."""
    own = scores.where("dimension_id = 'narrative'").groupBy("company_id")
    return own.agg(half_up(F.avg("risk_score"), 2).alias("narrative_index"))


def coverage_counts(scores: DataFrame, weighted: int = 18) -> DataFrame:
    """Scored indicators, scored weighted indicators and their share of all weighted ones."""
    scored = F.col("risk_score").isNotNull()
    inside = scored & (F.col("dimension_id") != "narrative")
    return scores.groupBy("company_id").agg(
        F.count_if(scored).alias("scored"), F.count_if(inside).alias("weighted_scored"), half_up(F.count_if(inside) / float(weighted), 4).alias("coverage")
    )


def score_industry(observations: DataFrame, companies: DataFrame, candidates: DataFrame) -> DataFrame:
    """Indicator scores of all companies: the whole chain from observations."""
    return peer_scores(resolved(with_composite(latest(observations)), candidates), companies)


def small_group_note(n: Column) -> Column:
    return F.when(n < 5, "small sample").otherwise("")


DIMENSION_ORDER = DIMENSIONS
