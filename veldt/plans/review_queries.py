"""Queries of the six-dimension index and of derived metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import numeric
from veldt.operators import enrich as E
from veldt.operators import merge as M
from veldt.operators import serving as V
from veldt.operators import sixdim as X
from veldt.operators import technology as T
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.plans.risk_queries import _HOLD
from veldt.registry import query
from veldt.sources import adapter as A

_REVIEWED = """n AS (SELECT count(*) AS n FROM supplier),
reviewed AS (SELECT doc_id AS observation_id, 'star-' || lpad(CAST(doc_id % n AS VARCHAR), 6, '0') AS company_id, 'i' || (doc_id % 12) AS indicator_id, 'd' || (doc_id % 6) AS dimension_id,
  CASE WHEN doc_id % 10 = 0 THEN 'draft' ELSE 'validated' END AS status, (2020 + (doc_id * 7) % 5) || '-' || lpad(CAST(1 + (doc_id * 5) % 12 AS VARCHAR), 2, '0') AS period, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS reviewed_at, CAST((doc_id * 31) % 101 AS DOUBLE) AS score FROM documents, n),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, indicator_id ORDER BY period DESC, reviewed_at DESC) AS k FROM reviewed WHERE status = 'validated') WHERE k = 1),
dims AS (SELECT company_id, dimension_id, CAST(floor(avg(score) + CAST('0.5' AS DOUBLE)) AS BIGINT) AS dimension_score FROM latest GROUP BY 1, 2)"""


def reviewed(spark, folder):
    n, d = A.supplier_count(spark, folder), F.col("doc_id")
    return A.table(spark, folder, "documents").select(
        d.alias("observation_id"), A.company_id(d % n).alias("company_id"), F.concat(F.lit("i"), d % 12).alias("indicator_id"), F.concat(F.lit("d"), d % 6).alias("dimension_id"),
        F.when(d % 10 == 0, "draft").otherwise("validated").alias("status"), F.concat(2020 + (d * 7) % 5, F.lit("-"), F.lpad((1 + (d * 5) % 12).cast("string"), 2, "0")).alias("period"),
        F.lpad(d.cast("string"), 12, "0").alias("reviewed_at"), ((d * 31) % 101).cast("double").alias("score"),
    )


@query(f"WITH {_REVIEWED} SELECT company_id, indicator_id, observation_id, period, score FROM latest")
def latest_reviewed(spark, folder):
    return X.latest_reviewed(reviewed(spark, folder)).select("company_id", "indicator_id", "observation_id", "period", "score")


@query(f"WITH {_REVIEWED} SELECT company_id, dimension_id, dimension_score FROM dims")
def reviewed_dimensions(spark, folder):
    return X.dimension_means(X.latest_reviewed(reviewed(spark, folder)))


@query(f"WITH {_REVIEWED} SELECT company_id, count(dimension_score) AS assessable, CASE WHEN count(dimension_score) >= 4 THEN CAST(floor(avg(dimension_score) + CAST('0.5' AS DOUBLE)) AS BIGINT) END AS index FROM dims GROUP BY 1")
def reviewed_index(spark, folder):
    return X.index(X.dimension_means(X.latest_reviewed(reviewed(spark, folder))))


_EVIDENCE = f"""{O.EVENTS}, evidence AS (SELECT company_id, kind <> 'litigation' AS effective, event_id % 3 = 0 AS scoring, 'https://e.example/' || CAST(trunc(value) AS BIGINT) AS url,
  CASE kind WHEN 'screening' THEN 'direct' WHEN 'inquiry' THEN 'inferred' ELSE 'background' END AS strength FROM risk_events)"""


def evidence(spark, folder):
    strength = F.when(F.col("kind") == "screening", "direct").when(F.col("kind") == "inquiry", "inferred").otherwise("background")
    return A.events(spark, folder).select(
        "company_id", (F.col("kind") != "litigation").alias("effective"), (F.col("event_id") % 3 == 0).alias("scoring"), F.concat(F.lit("https://e.example/"), F.col("value").cast("long")).alias("url"), strength.alias("strength")
    )


@query(f"""WITH {_EVIDENCE}, c AS (SELECT company_id, count(DISTINCT CASE WHEN effective AND scoring THEN url END) AS used, count(DISTINCT CASE WHEN effective THEN url END) AS known FROM evidence GROUP BY 1)
SELECT company_id, used, known, round(coalesce(used * CAST(100 AS DOUBLE) / nullif(known, 0), 0), 6) AS coverage FROM c""")
def evidence_coverage(spark, folder):
    return X.evidence_coverage(evidence(spark, folder)).withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH {_EVIDENCE} SELECT count(*) AS records, count(*) FILTER (effective) AS effective, count(*) FILTER (strength = 'direct') AS direct, count(*) FILTER (strength = 'inferred') AS inferred,
  count(*) FILTER (strength = 'background') AS background, count(*) FILTER (scoring) AS scoring, count(DISTINCT url) AS addresses FROM evidence""")
def governance_summary(spark, folder):
    return X.governance_summary(evidence(spark, folder))


_SHARE = "floor(({}) * CAST(100 AS DOUBLE) / greatest(n, 1) * CAST(1000000 AS DOUBLE) + CAST('0.5' AS DOUBLE)) / CAST(1000000 AS DOUBLE)".format


@query(f"""WITH i AS (SELECT source AS company_id, CASE toxic WHEN 1 THEN 'negative' WHEN 0 THEN 'positive' END AS sentiment, contains(text, 'License') AS keyword, lang FROM documents LEFT JOIN labels USING (doc_id)),
b AS (SELECT company_id, count(*) AS n, count(*) FILTER (sentiment = 'positive') AS p, count(*) FILTER (sentiment = 'negative') AS m, count(*) FILTER (keyword) AS k, count(DISTINCT lang) AS media FROM i GROUP BY 1)
SELECT company_id, n, media, {_SHARE('p')} AS positive_share, {_SHARE('m')} AS negative_share, {_SHARE('k')} AS keyword_share, {_SHARE('p - m')} AS tone_balance FROM b""")
def news_shares(spark, folder):
    d = A.table(spark, folder, "documents").join(A.table(spark, folder, "labels").select("doc_id", "toxic"), "doc_id", "left")
    items = d.select(F.col("source").alias("company_id"), F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive").alias("sentiment"), F.contains("text", F.lit("License")).alias("keyword"), F.col("lang").alias("media_name"))
    return E.news(items)


@query("""SELECT p_brand AS company_id, count(*) AS disclosed, count(*) FILTER (p_size % 3 <> 0) AS domestic, count(*) FILTER (p_size % 3 = 0) AS unresolved,
  coalesce(sum(CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END), 0) AS ratio_sum FROM part GROUP BY 1""")
def supplier_shares(spark, folder):
    size = F.col("p_size")
    items = A.table(spark, folder, "part").select(
        F.col("p_brand").alias("company_id"), F.when(size % 3 == 1, "city").otherwise(" ").alias("base"), F.when(size % 3 == 2, "town").alias("city"), F.when(size % 5 != 0, F.concat(F.lit("about "), size, F.lit("%"))).otherwise("none").alias("ratio")
    )
    return E.suppliers(items)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 1 + s_suppkey END AS total FROM supplier""")
def nested_risk_total(spark, folder):
    key = F.col("s_suppkey")
    payload = F.when(key % 4 == 0, F.lit('{"result": {}}')).otherwise(F.concat(F.lit('{"result": {"riskList": [{"count": 1}, {"name": "x"}, {"count": '), key, F.lit("}]}}")))
    return A.table(spark, folder, "supplier").select("s_suppkey", E.risk_total(payload).alias("total"))


@query("""SELECT o_custkey, string_agg(number, ',' ORDER BY number) AS numbers FROM (
  SELECT o_custkey, 'SRC-' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), 3, '0') AS number FROM orders) GROUP BY 1""")
def reference_numbers(spark, folder):
    o = A.table(spark, folder, "orders").select("o_custkey", M.ordinal(["o_custkey"], [F.col("o_orderkey")], "SRC-", 3).alias("number"))
    return o.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("number")), ",").alias("numbers"))


@query("""SELECT o_orderkey, source_ids FROM (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderstatus <> o_orderpriority THEN ',' || o_orderstatus ELSE '' END || ',x' AS source_ids FROM orders)""")
def linked_sources(spark, folder):
    o = A.table(spark, folder, "orders").select(F.col("o_orderkey").alias("observation_id"), F.col("o_orderpriority").alias("source_id"), "o_orderstatus")
    links = o.select("observation_id", F.explode(F.array(F.struct(F.lit(2).alias("p"), F.lit("x").alias("s")), F.struct(F.lit(1).alias("p"), F.col("o_orderstatus").alias("s")), F.struct(F.lit(3).alias("p"), F.col("source_id").alias("s")))).alias("l"))
    links = links.select("observation_id", F.col("l.p").alias("position"), F.col("l.s").alias("source_id"))
    out = M.linked_sources(o.select("observation_id", "source_id"), links)
    return out.select(F.col("observation_id").alias("o_orderkey"), F.array_join("source_ids", ",").alias("source_ids"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'patched' END, c_name) AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 5 <> 1""")
def patch_and_delete(spark, folder):
    c = A.table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("patched").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c_name"), F.lit("c_mktsegment"))).otherwise(F.array(F.lit("c_name"))).alias("given"))
    gone = c.where("c_custkey % 5 = 1").select("c_custkey")
    return M.cascade_deleted(M.patched(c, patch, ["c_custkey"]), c, gone, "c_custkey")[0]


@query("""SELECT only_in, count(*) AS n FROM (SELECT 'left' AS only_in, l_returnflag, l_linestatus FROM (SELECT l_returnflag, l_linestatus FROM lineitem EXCEPT ALL SELECT o_orderstatus, o_orderstatus FROM orders)
  UNION ALL SELECT 'right', o_orderstatus, o_orderstatus FROM (SELECT o_orderstatus, o_orderstatus AS b FROM orders EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem)) GROUP BY 1""")
def table_difference(spark, folder):
    a = A.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    o = A.table(spark, folder, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderstatus").alias("b"))
    return M.same_rows(a, o).groupBy("only_in").agg(F.count("*").alias("n"))


@query(f"WITH {O.EVENTS}, d AS (SELECT substr(event_date, 1, 10) AS day, kind, count(*) AS n FROM risk_events GROUP BY 1, 2) SELECT day, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, kind) AS k FROM d) WHERE k <= 2")
def top_kinds_by_day(spark, folder):
    d = A.events(spark, folder).groupBy(F.col("event_date").alias("day"), "kind").agg(F.count("*").alias("n"))
    return V.top_k(d, ["day"], [F.col("n").desc(), F.col("kind")], 2).select("day", "kind", "n")


# ---- technology baseline, display


@query(f"""WITH {O.COMPANIES}, rules(rule_id, low_op, low, medium_op, medium) AS (VALUES {C.as_values([(a, b, f"{c}", d, f"{e}") for a, b, c, d, e in C.BASELINE_BANDS])}),
v AS (SELECT company_id AS entity, rule_id, CASE WHEN s_suppkey % 8 <> 0 THEN CAST((s_suppkey * 11) % 90 AS DOUBLE) END AS value, low_op, CAST(low AS DOUBLE) AS low, medium_op, CAST(medium AS DOUBLE) AS medium FROM companies CROSS JOIN rules)
SELECT entity, rule_id, value, CASE WHEN value IS NULL THEN NULL WHEN {_HOLD("value", "low_op", "low")} THEN 25 WHEN {_HOLD("value", "medium_op", "medium")} THEN 60 ELSE 85 END AS score FROM v""")
def baseline_bands(spark, folder):
    key, rules = F.col("s_suppkey"), C.baseline_bands(spark)
    v = A.companies(spark, folder).join(F.broadcast(rules.select("rule_id")), F.lit(True)).select(
        F.col("company_id").alias("entity"), "rule_id", F.when(key % 8 != 0, ((key * 11) % 90).cast("double")).alias("value")
    )
    return T.banded(v, rules)


_D = "CAST({} AS DOUBLE)".format


@query(f"""WITH {O.COMPANIES} SELECT company_id, {_D('s_suppkey')} AS papers, {_D('s_suppkey % 30')} AS valid_patents, floor({_D(100)} * (s_suppkey % 9) / nullif(s_suppkey % 13, 0) * 100 + {_D("'0.5'")}) / 100 AS rd_intensity,
  floor({_D('s_suppkey % 50')} / nullif({_D('s_suppkey % 17')} / 100, 0) * 100 + {_D("'0.5'")}) / 100 AS ip_per_hundred, {_D('s_suppkey * 10')} AS contract_value, {_D("'0.25'")} AS negative_probability FROM companies""")
def official_metrics(spark, folder):
    key = F.col("s_suppkey")
    inputs = A.companies(spark, folder).select(
        "company_id", key.alias("papers"), (key % 30).alias("valid_patents"), (key % 9).alias("rd"), (key % 13).alias("revenue"), (key % 50).cast("double").alias("ip"),
        (key % 17).cast("double").alias("staff"), (key * 10).alias("contract"), F.lit(0.25).alias("negative_probability"),
    )
    return T.official_metrics(inputs)


@query("""WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey % 101 AS DOUBLE) END AS s FROM supplier), k AS (SELECT s_suppkey, s,
  floor(CASE WHEN s <= 50 THEN 34 + 216 * s / 50 ELSE 250 - 11 * (s - 50) / 50 END + CAST('0.5' AS DOUBLE))::INT AS r,
  floor(CASE WHEN s <= 50 THEN 211 - 7 * s / 50 ELSE 204 - 136 * (s - 50) / 50 END + CAST('0.5' AS DOUBLE))::INT AS g,
  floor(CASE WHEN s <= 50 THEN 238 - 217 * s / 50 ELSE 21 + 47 * (s - 50) / 50 END + CAST('0.5' AS DOUBLE))::INT AS b FROM c)
SELECT s_suppkey, CASE WHEN s IS NULL THEN '#64748b' ELSE '#' || lpad(lower(hex(r)), 2, '0') || lpad(lower(hex(g)), 2, '0') || lpad(lower(hex(b)), 2, '0') END AS colour FROM k""")
def heat_colours(spark, folder):
    s = A.table(spark, folder, "supplier")
    return s.select("s_suppkey", numeric.heat_colour(F.when(F.col("s_suppkey") % 13 != 0, (F.col("s_suppkey") % 101).cast("double"))).alias("colour"))
