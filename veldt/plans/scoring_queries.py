"""Queries of the peer-scoring chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.functions import numeric, text
from veldt.operators import scoring as S
from veldt.plans import oracle as O
from veldt.plans.catalogue import candidates
from veldt.registry import query
from veldt.sources import adapter as A
from veldt.sources.snapshots import written

D = "CAST({} AS DOUBLE)".format


def observed(spark: SparkSession, folder: str) -> DataFrame:
    """Observations, written: a hundredth of the bytes that are shuffled for them, for queries that read them more than once."""
    return written(A.observations(spark, folder), "observations")


def industry_scores(spark: SparkSession, folder: str, observations: DataFrame | None = None) -> DataFrame:
    """Indicator scores, written: later steps read them several times, and they are one row per company and indicator."""
    return written(S.score_industry(A.observations(spark, folder) if observations is None else observations, A.companies(spark, folder), candidates(spark)), "industry_scores")


@query(f"WITH {O.OBSERVATIONS} SELECT observation_id, company_id, indicator_id, metric_name, as_of_date, {O.half_up('numeric_value', 6)} AS numeric_value FROM observations")
def observation_scan(spark, folder):
    return A.observations(spark, folder).withColumn("numeric_value", numeric.half_up(F.col("numeric_value"), 6))


@query(f"WITH {O.SCORES} SELECT company_id, metric_name, as_of_date, observation_id, {O.half_up('numeric_value', 6)} AS numeric_value FROM newest")
def latest_observation(spark, folder):
    return S.latest(A.observations(spark, folder)).withColumn("numeric_value", numeric.half_up(F.col("numeric_value"), 6))


@query(f"WITH {O.SCORES} SELECT company_id, indicator_id, rank, metric_name, comparable_group FROM resolved")
def candidate_fallback(spark, folder):
    found = S.resolved(S.with_composite(S.latest(A.observations(spark, folder))), candidates(spark))
    return found.select("company_id", "indicator_id", "rank", "metric_name", "comparable_group")


@query("""WITH {} SELECT company_id, numeric_value, CAST(count(*) OVER (PARTITION BY company_id) AS BIGINT) AS n FROM with_composite WHERE metric_name = 'export_control_list_hits'""".format(O.SCORES))
def composite_sum(spark, folder):
    return S.with_composite(S.latest(A.observations(spark, folder))).where("metric_name = 'export_control_list_hits'").select(
        "company_id", "numeric_value", F.lit(1).cast("long").alias("n")
    )


@query(f"""WITH {O.SCORES} SELECT company_id, benchmark_group, indicator_id, dimension_id, metric_name, comparable_group, {O.half_up('numeric_value', 6)} AS numeric_value,
  sample_size, risk_percentile, risk_score, risk_score - 50 AS centered, CASE WHEN risk_score IS NULL THEN 'missing' ELSE 'scored' END AS status FROM scores""")
def peer_risk_score(spark, folder):
    return industry_scores(spark, folder).withColumn("numeric_value", numeric.half_up(F.col("numeric_value"), 6))


def _weights_sql(method: str) -> str:
    first = O.weights("first", f"SELECT benchmark_group, company_id, indicator_id AS column_name, risk_score / {D(100)} AS x FROM scores WHERE dimension_id <> 'narrative'", method)
    return f"WITH {O.SCORES}, {first} SELECT benchmark_group, column_name AS indicator_id, weight FROM first_weights"


def _weights(spark, folder, method):
    matrix = industry_scores(spark, folder).select("benchmark_group", "company_id", F.col("indicator_id").alias("column"), (F.col("risk_score") / 100.0).alias("x"))
    w = S.objective_weights(matrix, method)
    return w.select("benchmark_group", F.col("column").alias("indicator_id"), "weight")


@query(_weights_sql("critic"))
def critic_weights(spark, folder):
    return _weights(spark, folder, "critic")


@query(_weights_sql("entropy"))
def entropy_weights(spark, folder):
    return _weights(spark, folder, "entropy")


@query(f"""WITH {O.SCORES},
m AS (SELECT benchmark_group, company_id, indicator_id AS c, risk_score / {D(100)} AS x FROM scores WHERE risk_score IS NOT NULL),
p AS (SELECT a.benchmark_group, a.c AS a, b.c AS b, a.x, b.x AS y, avg(a.x) OVER w AS mx, avg(b.x) OVER w AS my FROM m a JOIN m b ON a.benchmark_group = b.benchmark_group AND a.company_id = b.company_id AND a.c <> b.c WINDOW w AS (PARTITION BY a.benchmark_group, a.c, b.c)),
s AS (SELECT benchmark_group, a, b, count(*) AS pairs, sum((x-mx)*(y-my)) AS sxy, sum((x-mx)*(x-mx)) AS sxx, sum((y-my)*(y-my)) AS syy FROM p GROUP BY 1, 2, 3)
SELECT benchmark_group, a, b, pairs, round(CASE WHEN pairs < 2 OR sxx * syy = 0 THEN 0 ELSE sxy / sqrt(sxx * syy) END, 6) + CAST(0 AS DOUBLE) AS rho FROM s""")
def pairwise_correlation(spark, folder):
    scores = industry_scores(spark, folder).where("risk_score is not null")
    m = scores.select("benchmark_group", "company_id", F.col("indicator_id").alias("column"), (F.col("risk_score") / 100.0).alias("x"))
    return S.correlations(m).select("benchmark_group", "a", "b", "pairs", (F.round("rho", 6) + 0.0).alias("rho"))


def _total_sql(method: str) -> str:
    return f"WITH {O.totals(method)} SELECT company_id, benchmark_group, total_score, dimensions_scored, '{method}' AS method FROM total"


@query(_total_sql("critic"))
def industry_total_score(spark, folder):
    return S.method_results(industry_scores(spark, folder), "critic")[3].withColumn("method", F.lit("critic"))


@query(_total_sql("entropy"))
def industry_total_score_entropy(spark, folder):
    return S.method_results(industry_scores(spark, folder), "entropy")[3].withColumn("method", F.lit("entropy"))


@query(f"WITH {O.totals('critic')} SELECT company_id, benchmark_group, dimension_id, dimension_score FROM dims")
def dimension_score(spark, folder):
    return S.method_results(industry_scores(spark, folder), "critic")[1]


@query(f"WITH {O.totals('critic')} SELECT benchmark_group, column_name AS dimension_id, weight FROM second_weights")
def second_stage_weights(spark, folder):
    w = S.method_results(industry_scores(spark, folder), "critic")[2]
    return w.select("benchmark_group", F.col("column").alias("dimension_id"), "weight")


@query(f"""WITH {O.SCORES} SELECT company_id, count(risk_score) AS scored, count(*) FILTER (risk_score IS NOT NULL AND dimension_id <> 'narrative') AS weighted_scored,
  {O.half_up("count(*) FILTER (risk_score IS NOT NULL AND dimension_id <> 'narrative') / CAST(18 AS DOUBLE)", 4)} AS coverage FROM scores GROUP BY 1""")
def coverage_ratio(spark, folder):
    return S.coverage_counts(industry_scores(spark, folder))


@query(f"""WITH {O.OBSERVATIONS}, q AS (SELECT company_id, metric_name, count(*) AS n, quantile_cont(numeric_value, {D('0.05')}) AS p05, quantile_cont(numeric_value, {D('0.5')}) AS median,
  quantile_cont(numeric_value, {D('0.95')}) AS p95 FROM observations GROUP BY 1, 2)
SELECT company_id, metric_name, n, round(median, 6) AS median, CASE WHEN n >= 3 AND p95 - p05 <> 0 THEN {O.half_up('least(greatest((median - p05) / (p95 - p05), 0), 1)', 4)} END AS anchor FROM q""")
def historical_anchor(spark, folder):
    q = S.quantiles(A.observations(spark, folder), ["company_id", "metric_name"])
    return q.select("company_id", "metric_name", "n", F.round("median", 6).alias("median"), S.historical_anchor(q).alias("anchor"))


@query(f"""WITH {O.SCORES}, q AS (SELECT company_id, metric_name, count(*) AS n, quantile_cont(numeric_value, {D('0.05')}) AS p05, quantile_cont(numeric_value, {D('0.5')}) AS median,
  quantile_cont(numeric_value, {D('0.95')}) AS p95 FROM observations GROUP BY 1, 2),
a AS (SELECT company_id, metric_name, CASE WHEN n >= 3 AND p95 - p05 <> 0 THEN {O.half_up('least(greatest((median - p05) / (p95 - p05), 0), 1)', 4)} END AS anchor FROM q)
SELECT company_id, indicator_id, anchor, CASE WHEN anchor + risk_percentile IS NOT NULL THEN {O.half_up(f"{D(100)} * least(greatest({D('0.5')} * anchor + {D('0.5')} * risk_percentile, 0), 1)", 2)} END AS full_score FROM scores JOIN a USING (company_id, metric_name)""")
def full_anchor_score(spark, folder):
    o = observed(spark, folder)
    q = S.quantiles(o, ["company_id", "metric_name"])
    anchors = q.select("company_id", "metric_name", S.historical_anchor(q).alias("anchor"))
    joined = industry_scores(spark, folder, o).join(anchors, ["company_id", "metric_name"])
    return joined.select("company_id", "indicator_id", "anchor", S.full_score(F.col("anchor"), F.col("risk_percentile")).alias("full_score"))


@query(f"""WITH {O.SCORES} SELECT company_id, indicator_id, risk_score, k FROM (
  SELECT * EXCLUDE (k), row_number() OVER (PARTITION BY company_id ORDER BY risk_score DESC, indicator_id) AS k FROM scores WHERE risk_score IS NOT NULL) WHERE k <= 5""")
def top_five_metrics(spark, folder):
    from veldt.operators.serving import top_k

    return top_k(industry_scores(spark, folder).where("risk_score is not null"), ["company_id"], [F.col("risk_score").desc(), F.col("indicator_id")], 5).select(
        "company_id", "indicator_id", "risk_score", "k"
    )


@query(f"""WITH {O.totals('critic')}, cov AS (SELECT company_id, count(risk_score) AS scored FROM scores GROUP BY 1)
SELECT company_id, benchmark_group, total_score, scored, row_number() OVER (PARTITION BY benchmark_group ORDER BY coalesce(total_score, -1) DESC, scored DESC, company_id) AS place
FROM total JOIN cov USING (company_id)""")
def peer_ranking(spark, folder):
    from veldt.operators.serving import peer_ranking as rank

    scores = industry_scores(spark, folder)
    totals = S.method_results(scores, "critic")[3]
    return rank(totals.join(S.coverage_counts(scores).select("company_id", "scored"), "company_id")).select(
        "company_id", "benchmark_group", "total_score", "scored", "place"
    )


@query(f"""WITH {O.totals('critic')}, top2 AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY dimension_score DESC, dimension_id) AS k FROM dims)
SELECT company_id, string_agg(dimension_id, ', ' ORDER BY k) AS labels, max(CASE WHEN k = 1 THEN dimension_id END) AS highest FROM top2 WHERE k <= 2 GROUP BY 1""")
def top_two_dimensions(spark, folder):
    from veldt.operators.serving import top_k

    dims = S.method_results(industry_scores(spark, folder), "critic")[1]
    two = top_k(dims, ["company_id"], [F.col("dimension_score").desc(), F.col("dimension_id")], 2)
    labels = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "dimension_id"))), lambda x: x["dimension_id"]), ", ")
    return two.groupBy("company_id").agg(labels.alias("labels"), F.max(F.when(F.col("k") == 1, F.col("dimension_id"))).alias("highest"))


@query(f"""WITH {O.totals('critic')}, t AS (SELECT company_id, total_score FROM total), a AS (SELECT * FROM dims WHERE company_id = 'star-000001'), b AS (SELECT * FROM dims WHERE company_id = 'star-000002')
SELECT a.dimension_id, a.dimension_score AS left_score, b.dimension_score AS right_score, round(a.dimension_score - b.dimension_score, 2) AS gap FROM a LEFT JOIN b USING (dimension_id)""")
def compare_two_companies(spark, folder):
    from veldt.operators.serving import compare

    dims = S.method_results(industry_scores(spark, folder), "critic")[1]
    return compare(dims, "star-000001", "star-000002")


@query(f"""WITH {O.SCORES} SELECT company_id, indicator_id, CASE WHEN risk_score IS NULL THEN 'neutral' WHEN risk_score >= 65 THEN 'critical' WHEN risk_score >= 55 THEN 'high' WHEN risk_score >= 45 THEN 'medium' ELSE 'low' END AS tone,
  CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score IS NOT NULL THEN 'low' END AS index_level,
  CASE WHEN risk_score < 25 THEN 'low' WHEN risk_score < 50 THEN 'medium' WHEN risk_score < 75 THEN 'high' WHEN risk_score IS NOT NULL THEN 'critical' END AS risk_level FROM scores""")
def risk_levels(spark, folder):
    s = F.col("risk_score")
    return industry_scores(spark, folder).select(
        "company_id", "indicator_id", numeric.tone(s).alias("tone"), numeric.index_level(s).alias("index_level"), numeric.risk_level(s).alias("risk_level")
    )


@query(f"WITH {O.COMPANIES} SELECT stock_code, company_id, benchmark_group, 'group-' || peer_group_id || ':' || company_id AS namespaced FROM companies")
def stable_ids(spark, folder):
    c = A.companies(spark, folder)
    return c.select("stock_code", "company_id", "benchmark_group", text.namespaced(F.concat(F.lit("group-"), "peer_group_id"), F.col("company_id")).alias("namespaced"))
