"""Query of report references."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import export as X
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.registry import query
from veldt.sources import adapter as A

_DIMS = [d for d, _ in C.FIXED_DIMENSIONS]


def report_parts(spark, folder) -> tuple:
    key, p = F.col("s_suppkey"), F.col("place")
    c = A.companies(spark, folder).select("company_id", "s_suppkey")
    proof = lambda n: F.concat_ws("-", F.lit("EV"), n)
    dims = c.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "company_id", F.get(F.array(*map(F.lit, _DIMS)), p).alias("label"), "place", F.when((key + p) % 4 != 0, 50.0).alias("score"), F.when(p == 0, X.AUTOMATIC).otherwise("other").alias("score_basis"),
        F.array(proof((p + key) % 4), proof((p * 2 + key) % 6)).alias("evidence_ids"), F.array(F.lit("T02"), F.lit("T01")).alias("indicator_ids"),
    )
    e, i = A.events(spark, folder).join(c, "company_id"), F.col("event_id")
    events = e.select(
        "company_id", i.cast("string").alias("event_id"), i.alias("place"), F.when(i % 3 != 0, F.array(proof(i % 8), proof(i % 5))).otherwise(F.array().cast("array<string>")).alias("evidence_ids"),
        F.when(i % 4 != 0, F.concat(F.lit("https://e.example/"), i % 5)).alias("source_url"), F.when(i % 2 == 0, "press").alias("source_name"), F.lit("web").alias("source_type"), F.col("kind").alias("risk_type"),
        F.when(i % 5 == 0, "2024-01-01").alias("source_published_at"), F.col("event_date").alias("identified_at"),
    )
    bindings = c.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(5)))).select(
        "company_id", proof((key + p) % 7).alias("evidence_id"), F.concat(F.lit(" C0"), p % 3 + 1).alias("indicator_id"), F.when(p % 5 == 4, " ").otherwise("2024").alias("period"), F.concat(F.lit("p. "), p % 2).alias("locator"), "place"
    )
    evidence = c.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "company_id", proof(p).alias("evidence_id"), F.concat(F.lit("source "), p).alias("source_name"), F.concat(F.lit("title "), p).alias("title"), F.when(p > 0, "2023-05-01").alias("published_at"),
        F.concat(F.lit("https://e.example/"), p).alias("source_url"), F.get(F.array(F.lit("direct"), F.lit("inferred"), F.lit("background"), F.lit(None).cast("string")), p % 4).alias("support"),
    )
    return dims, events, bindings, evidence


@query(f"""WITH {O.COMPANIES}, {O.EVENTS}, d AS (SELECT company_id, {"['" + "', '".join(_DIMS) + "']"}[p + 1] AS label, p, (s_suppkey + p) % 4 <> 0 AS scored, ['EV-' || ((p + s_suppkey) % 4), 'EV-' || ((p * 2 + s_suppkey) % 6)] AS ev FROM companies, range(5) t(p)),
v AS (SELECT company_id, event_id AS i, kind, event_date, CASE WHEN event_id % 3 <> 0 THEN ['EV-' || (event_id % 8), 'EV-' || (event_id % 5)] ELSE [] END AS ev, CASE WHEN event_id % 4 <> 0 THEN 'https://e.example/' || (event_id % 5) END AS url FROM risk_events SEMI JOIN companies USING (company_id)),
b AS (SELECT company_id, p, 'EV-' || ((s_suppkey + p) % 7) AS ev, 'C0' || (p % 3 + 1) AS ind, CASE WHEN p % 5 = 4 THEN '' ELSE '2024' END AS period, 'p. ' || (p % 2) AS locator FROM companies, range(6) t(p)),
g AS (SELECT company_id, 'EV-' || p AS ev, p FROM companies, range(5) t(p)),
dx AS (SELECT company_id, label, p, scored, unnest(ev) AS ev, generate_subscripts(ev, 1) AS j FROM d), vx AS (SELECT company_id, i, unnest(ev) AS ev, generate_subscripts(ev, 1) AS j FROM v),
f AS (SELECT company_id, ev, min(o) AS o FROM (SELECT company_id, ev, 0 * 1000000000 + p * 10 + j AS o FROM dx UNION ALL SELECT company_id, ev, 1000000000 + i * 10 + j FROM vx UNION ALL SELECT company_id, ev, 900000000000 + p * 10 FROM b) GROUP BY 1, 2),
auto AS (SELECT DISTINCT company_id, ev FROM dx WHERE p = 0 AND scored),
lk AS (SELECT company_id, ev, ind, min(p) AS p FROM b WHERE period <> '' GROUP BY 1, 2, 3), l1 AS (SELECT company_id, ev, string_agg(ind, ',' ORDER BY p) AS inds FROM lk GROUP BY 1, 2), l2 AS (SELECT DISTINCT company_id, ev FROM b WHERE period <> ''),
lo AS (SELECT company_id, ev, string_agg(locator, ',' ORDER BY p) AS locators FROM (SELECT company_id, ev, locator, min(p) AS p FROM b WHERE period <> '' GROUP BY 1, 2, 3) GROUP BY 1, 2),
ve AS (SELECT company_id, ev, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS events FROM (SELECT DISTINCT company_id, ev, i FROM vx) GROUP BY 1, 2),
dl AS (SELECT company_id, ev, string_agg(label, ',' ORDER BY p) AS labels FROM (SELECT DISTINCT company_id, ev, label, p FROM dx) GROUP BY 1, 2),
r AS (SELECT f.company_id, 0 AS k, o, f.ev, g.p, auto.ev IS NOT NULL OR (labels IS NOT NULL AND l2.ev IS NOT NULL) AS scored, l2.ev IS NOT NULL AS linked, events, labels, auto.ev IS NOT NULL AS automatic, inds, locators
  FROM f LEFT JOIN g USING (company_id, ev) LEFT JOIN auto USING (company_id, ev) LEFT JOIN l1 USING (company_id, ev) LEFT JOIN l2 USING (company_id, ev) LEFT JOIN lo USING (company_id, ev) LEFT JOIN ve USING (company_id, ev) LEFT JOIN dl USING (company_id, ev)),
own AS (SELECT DISTINCT vx.company_id, i, 'https://e.example/' || p AS url FROM vx JOIN g USING (company_id, ev)),
x AS (SELECT v.* FROM v ANTI JOIN own USING (company_id, i, url) WHERE url IS NOT NULL),
y AS (SELECT company_id, url, min(i) AS o, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS events, arg_min(kind, i) AS kind, arg_min(CASE WHEN i % 5 = 0 THEN '2024-01-01' ELSE event_date END, i) AS day FROM x GROUP BY 1, 2),
z AS (SELECT company_id, k, o, CASE WHEN events IS NOT NULL AND scored THEN '事件来源 + 评分证据' WHEN events IS NOT NULL AND linked THEN '事件来源 + 评分观测（未计分）' WHEN scored THEN '评分证据' WHEN linked THEN '评分观测来源（未计分）' ELSE '事件来源' END AS role, ev AS evidence_id,
    coalesce('source ' || p, '来源记录缺失') AS source_name, coalesce('title ' || p, '未找到对应证据记录') AS title, CASE WHEN p > 0 THEN '2023-05-01' ELSE '' END AS published_at, coalesce('https://e.example/' || p, '') AS source_url,
    coalesce(['直接披露', '推导支持', '背景材料', NULL][p % 4 + 1], '待治理') AS support, CASE WHEN scored THEN '是' ELSE '否' END AS eligible, concat_ws(',', CASE WHEN automatic THEN 'T02,T01' END, inds) AS indicator_ids,
    CASE WHEN linked THEN '2024' ELSE '' END AS periods, coalesce(locators, '') AS locators, coalesce(events, '') AS event_ids, coalesce(labels, '') AS dimension_labels FROM r
  UNION ALL SELECT company_id, 1, o, '事件来源', '', CASE WHEN o % 2 = 0 THEN 'press' ELSE 'web' END, kind || '事件直接来源', day, url, '待治理', '否', '', '', '', events, '' FROM y)
SELECT company_id, 'SRC-' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS reference_id, role, evidence_id, source_name, title, published_at, source_url, support, eligible, indicator_ids, periods, locators, event_ids, dimension_labels
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY k, o, evidence_id, source_url) AS n FROM z)""")
def report_references(spark, folder):
    out = X.references(*report_parts(spark, folder)).drop("number")
    arrays = ("indicator_ids", "periods", "locators", "event_ids", "dimension_labels")
    return out.select(*(F.concat_ws(",", c).alias(c) if c in arrays else c for c in out.columns))
