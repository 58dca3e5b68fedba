"""Queries of what a reader sees of a company."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import company_views as V
from veldt.operators import events as E
from veldt.operators import scoring as S
from veldt.operators import serving
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.plans.event_queries import _RAW, raw_events
from veldt.plans.scoring_queries import industry_scores, observed
from veldt.registry import query
from veldt.sources import adapter as A

_SNAPSHOT = "2024-02-15"
#: sources of indicators, but one that is unknown; of several types
_TYPES = (("公告", "上交所", "问询"), ("年报", "公司", "2023年报"), ("官方名单", "联邦公报", "清单"), ("新闻", "Wind", "报道"), ("报告", "天眼查", "定期报告汇总"))
_SOURCES = [(f"src-{i}", *_TYPES[n % 5], "licensed-derived" if n % 5 == 4 else "public-link-only") for n, (i, _, _, _) in enumerate(C.CATALOGUE) if i != "R18"]
_DIMS = [(p, d, V.LABELS[d], f"{len(i)}/22") for p, (d, i) in enumerate(V.DIMENSIONS.items())]
_OF = [(i, d) for d, found in V.DIMENSIONS.items() for i in found]


def graded(spark, folder):
    e = raw_events(spark, folder)
    return e.withColumn("severity", E.severity(F.col("kind"), F.col("event_type"), F.col("title")))


def sources(spark):
    return spark.createDataFrame(_SOURCES, "source_id string, source_type string, institution string, title string, redistribution string")


def cited(spark, folder, observations=None):
    """Observations with a unit, a status, the source of each and further sources of some."""
    i, month = F.col("indicator_id"), F.substring("as_of_date", 6, 2).cast("int")
    return (A.observations(spark, folder) if observations is None else observations).select(
        "*", F.when(F.col("metric_name").endswith("_pct"), "%").alias("unit"), F.lit(None).cast("string").alias("text_value"), F.lit("known").alias("status"), (month / 16.0).alias("confidence"),
        F.concat(F.lit("src-"), i).alias("source_id"), F.when(i == "R05", F.array(F.lit("src-R06"), F.lit("src-R07"), F.lit("src-R05"))).alias("source_ids"),
    )


def supplements(spark, folder):
    n = F.col("event_id")
    return A.events(spark, folder).where("kind = 'deep-search'").select("company_id", F.when(n % 2 == 0, "src-R21").when(n % 3 == 0, "src-R18").alias("source_id"))


_GRADED = f"""{_RAW}, g AS (SELECT *, list_position(['{"', '".join(V.KINDS)}'], kind) AS k FROM graded)"""


@query(f"""WITH {_GRADED}, lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, k, event_id) AS n FROM g) WHERE n = 1),
high AS (SELECT * FROM (SELECT company_id, title, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, k, event_id) AS n FROM g WHERE severity = 'high') WHERE n = 1),
c AS (SELECT company_id, count(*) FILTER (severity = 'high') AS high_events, count(*) FILTER (severity = 'medium') AS medium_events, count(*) AS events FROM g GROUP BY 1)
SELECT c.*, lead.event_id AS lead_event_id, lead.event_type AS lead_event_type, lead.indicator_id AS lead_indicator_id, high.title AS high_title FROM c JOIN lead USING (company_id) LEFT JOIN high USING (company_id)""")
def event_overview(spark, folder):
    return V.event_overview(graded(spark, folder))


@query(f"""WITH {O.SCORES}, dd(place, dimension_id, label, weight) AS (VALUES {C.as_values(_DIMS)}),
m AS (SELECT company_id, dimension_id, (2 * sum(CAST(round(risk_score * 100) AS BIGINT)) + 100 * count(*)) // (200 * count(*)) AS score, string_agg(DISTINCT indicator_id, '、' ORDER BY indicator_id) AS ids FROM scores WHERE risk_score IS NOT NULL GROUP BY 1, 2)
SELECT company_id, dimension_id, place, label, weight, CAST(coalesce(score, 0) AS BIGINT) AS score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 60 THEN 'medium-high' WHEN score >= 40 THEN 'attention' ELSE 'low' END AS level,
  coalesce(ids, '') AS indicator_ids, CASE WHEN score IS NULL THEN '{V.NO_SCORE}' ELSE '{V.SCORED[0]}' || ids || '{V.SCORED[1]}' END AS summary FROM companies CROSS JOIN dd LEFT JOIN m USING (company_id, dimension_id)""")
def company_dimensions(spark, folder):
    return V.company_dimensions(A.companies(spark, folder), industry_scores(spark, folder)).withColumn("indicator_ids", F.array_join("indicator_ids", "、"))


_NAMED = f"""src(source_id, source_type, institution, title, redistribution) AS (VALUES {C.as_values(_SOURCES)}),
links AS (SELECT company_id, observation_id, indicator_id, metric_name, as_of_date, CASE WHEN metric_name LIKE '%\\_pct' ESCAPE '\\' THEN '%' END AS unit, CAST(substr(as_of_date, 6, 2) AS INTEGER) / CAST(16 AS DOUBLE) AS confidence, 'src-' || indicator_id AS source_id FROM observations
  UNION ALL SELECT company_id, observation_id, indicator_id, metric_name, as_of_date, NULL, CAST(substr(as_of_date, 6, 2) AS INTEGER) / CAST(16 AS DOUBLE), unnest(['src-R06', 'src-R07']) FROM observations WHERE indicator_id = 'R05'),
extra AS (SELECT company_id, CASE WHEN event_id % 2 = 0 THEN 'src-R21' WHEN event_id % 3 = 0 THEN 'src-R18' END AS source_id FROM risk_events WHERE kind = 'deep-search'),
named AS (SELECT DISTINCT company_id, source_id FROM (SELECT company_id, source_id FROM links UNION ALL SELECT * FROM extra) JOIN src USING (source_id))"""

_BEHIND_EVENTS = _GRADED.removeprefix(O.EVENTS)
_SUMMARY = O.totals("critic") + _BEHIND_EVENTS


@query(f"""WITH {_SUMMARY}, {_NAMED}, dd(place, dimension_id, label, weight) AS (VALUES {C.as_values(_DIMS)}),
nri AS (SELECT company_id, 'narrative' AS dimension_id, {O.half_up('avg(risk_score)', 2)} AS dimension_score FROM scores WHERE dimension_id = 'narrative' AND risk_score IS NOT NULL GROUP BY 1),
top AS (SELECT company_id, string_agg(label, '|' ORDER BY n) AS top_risks FROM (SELECT company_id, label, row_number() OVER (PARTITION BY company_id ORDER BY dimension_score DESC, place) AS n
  FROM (SELECT company_id, dimension_id, dimension_score FROM dims UNION ALL SELECT * FROM nri) JOIN dd USING (dimension_id)) WHERE n <= 2 GROUP BY 1),
c AS (SELECT company_id, count(*) FILTER (severity = 'high') AS high_events, count(*) FILTER (severity = 'medium') AS medium_events, count(*) AS events FROM g GROUP BY 1),
s AS (SELECT company_id, count(*) AS n FROM named GROUP BY 1), p AS (SELECT company_id, coalesce(lead(company_id) OVER w, first_value(company_id) OVER (PARTITION BY benchmark_group ORDER BY company_id)) AS peer FROM companies WINDOW w AS (PARTITION BY benchmark_group ORDER BY company_id)),
high AS (SELECT * FROM (SELECT company_id, title, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, k, event_id) AS n FROM g WHERE severity = 'high') WHERE n = 1)
SELECT company_id, short_name AS name, total_score AS risk_index, coalesce(top_risks, '') AS top_risks, coalesce(s.n, 0) + coalesce(events, 0) AS evidence_count, coalesce(high_events, 0) AS high_events, coalesce(medium_events, 0) AS medium_events,
  peer AS benchmark_company_id, coalesce(high.title, '{V.NO_HIGH_EVENT}') AS current_high_event
FROM companies LEFT JOIN total USING (company_id) LEFT JOIN top USING (company_id) LEFT JOIN c USING (company_id) LEFT JOIN s USING (company_id) LEFT JOIN p USING (company_id) LEFT JOIN high USING (company_id)""")
def company_summaries(spark, folder):
    o = observed(spark, folder)
    scores, c = industry_scores(spark, folder, o), A.companies(spark, folder)
    _, dims, _, totals = S.method_results(scores, "critic")
    narrative = S.narrative_index(scores).select("company_id", F.lit("narrative").alias("dimension_id"), F.col("narrative_index").alias("dimension_score"))
    every = dims.select("company_id", "dimension_id", "dimension_score").unionByName(narrative)
    evidence = V.used_sources([(cited(spark, folder, o), "source_id", "source_ids"), (supplements(spark, folder), "source_id", None)], sources(spark))
    out = V.company_summaries(c, totals, every, V.event_overview(graded(spark, folder)), evidence, serving.next_peer(c))
    return out.withColumn("top_risks", F.array_join("top_risks", "|"))


@query(f"""WITH {O.COMPANIES}, {_GRADED.lstrip()}, m AS (SELECT strftime(CAST('2023-09-01' AS DATE) + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month FROM range(6) t(i))
SELECT c.company_id, m.month, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(event_id) AS total FROM companies c CROSS JOIN m LEFT JOIN g ON g.company_id = c.company_id AND substr(event_date, 1, 7) = m.month GROUP BY 1, 2""")
def company_trend(spark, folder):
    return V.company_trend(A.companies(spark, folder), graded(spark, folder), _SNAPSHOT)


_LATEST = f"""{O.OBSERVATIONS}, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id, indicator_id ORDER BY as_of_date DESC, observation_id) AS n FROM observations) WHERE n = 1)"""


@query(f"""WITH {_LATEST}, shown AS (SELECT company_id, indicator_id, metric_name, as_of_date AS period, row_number() OVER (PARTITION BY company_id ORDER BY indicator_id) AS place,
  rtrim(rtrim(format('{{:,.4f}}', round(numeric_value, 4)), '0'), '.') || CASE WHEN ends_with(metric_name, '_pct') THEN ' %' ELSE '' END AS value FROM newest)
SELECT company_id, CAST(place AS INTEGER) AS place, indicator_id, metric_name, value, period FROM shown WHERE place <= 16""")
def company_disclosures(spark, folder):
    return V.disclosures(V.latest_by_indicator(cited(spark, folder)))


@query(f"""WITH {O.OBSERVATIONS}, {_NAMED}, of(indicator_id, d) AS (VALUES {C.as_values(_OF)}), dd(place, d, label, weight) AS (VALUES {C.as_values(_DIMS)}),
seen AS (SELECT company_id, source_id, indicator_id, min(observation_id) AS p FROM links GROUP BY 1, 2, 3),
i AS (SELECT company_id, source_id, string_agg(indicator_id, ',' ORDER BY p) AS ids FROM seen GROUP BY 1, 2),
l AS (SELECT company_id, source_id, string_agg(label, ',' ORDER BY p) AS dims FROM (SELECT company_id, source_id, label, min(p) AS p FROM seen JOIN of USING (indicator_id) JOIN dd USING (d) GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT company_id, source_id, max(confidence) AS most, count(*) AS n FROM links GROUP BY 1, 2),
f AS (SELECT company_id, source_id, string_agg(concat_ws(':', indicator_id, as_of_date, u, metric_name), '|' ORDER BY k) AS links FROM (SELECT *, CASE WHEN metric_name LIKE '%\\_pct' ESCAPE '\\' THEN '%' END AS u, row_number() OVER (PARTITION BY company_id, source_id ORDER BY observation_id) AS k FROM links) WHERE k <= 20 GROUP BY 1, 2)
SELECT company_id, source_id, CASE WHEN regexp_matches(source_type || ' ' || institution, '上交所|交易所') THEN 'exchange' WHEN regexp_matches(source_type || ' ' || institution, '年报|定期报告|招股') THEN 'filing'
  WHEN regexp_matches(source_type || ' ' || institution, '政府|监管|官方|联邦公报|清单') THEN 'official' ELSE 'media' END AS reliability, coalesce(ids, '') AS indicator_ids, coalesce(dims, '{V.NARRATIVE}') AS dimensions,
  greatest(CASE redistribution WHEN 'licensed-derived' THEN CAST('0.65' AS DOUBLE) ELSE CAST('0.75' AS DOUBLE) END, most) AS confidence, CASE redistribution WHEN 'licensed-derived' THEN 'background' ELSE 'direct' END AS strength,
  coalesce(n, 0) AS observations, coalesce(f.links, '') AS links
FROM named JOIN src USING (source_id) LEFT JOIN i USING (company_id, source_id) LEFT JOIN l USING (company_id, source_id) LEFT JOIN t USING (company_id, source_id) LEFT JOIN f USING (company_id, source_id)""")
def company_evidence(spark, folder):
    out = V.source_evidence(cited(spark, folder, observed(spark, folder)), supplements(spark, folder), sources(spark))
    return out.select(*(F.array_join(c, "|" if c == "links" else ",").alias(c) if c in ("indicator_ids", "dimensions", "links") else c for c in out.columns))


_STATUS = "CASE WHEN s % 4 = 0 THEN 'NA-none' ELSE 'collected' END"


@query(f"""WITH {_LATEST}, src(source_id) AS (VALUES {C.as_values([(s[0],) for s in _SOURCES])}), n AS (SELECT *, CAST(substr(company_id, 6) AS BIGINT) + CAST(substr(indicator_id, 2) AS BIGINT) AS s FROM newest)
SELECT company_id, indicator_id, observation_id, CASE WHEN s % 7 = 0 THEN 'unavailable' WHEN s % 3 = 0 THEN 'available' WHEN s % 4 <> 0 THEN 'partial' ELSE 'unavailable' END AS status,
  CASE WHEN s % 7 <> 0 AND s % 3 = 0 THEN 'reviewed' ELSE 'pending' END AS review_status, as_of_date AS period, CASE WHEN indicator_id <> 'R18' THEN 'r01-evidence:src-' || indicator_id END AS evidence_id FROM n""")
def indicator_observations(spark, folder):
    """Coverage is derived from the keys: absent for every seventh pair, usable for every third, NA for every fourth."""
    c = A.companies(spark, folder).select("company_id", "s_suppkey", F.explode(F.array(*(F.lit(i) for i, _ in _OF))).alias("indicator_id"))
    c = c.withColumn("s", F.col("s_suppkey") + F.substring("indicator_id", 2, 2).cast("long")).where("s % 7 <> 0")
    coverage = c.select("company_id", "indicator_id", F.expr(_STATUS).alias("status"), (F.col("s") % 3 == 0).alias("usable"))
    return V.indicator_observations(V.latest_by_indicator(cited(spark, folder)), coverage, sources(spark))


@query(f"""WITH {O.OBSERVATIONS}, {_NAMED} SELECT (SELECT count(*) FROM src) AS sources, (SELECT count(*) FROM src WHERE regexp_matches(source_type || institution, '官方|上交所|交易所|联邦公报')) AS official,
  (SELECT count(*) FROM src WHERE regexp_matches(source_type || title, '年报|定期报告|招股')) AS filings, (SELECT count(*) FROM risk_events) AS events, (SELECT count(*) FROM risk_events WHERE kind = 'deep-search') AS deep_search,
  (SELECT count(*) FROM extra) AS supplements, (SELECT count(*) FROM named) + (SELECT count(*) FROM risk_events) AS evidence""")
def manifest_statistics(spark, folder):
    o, more = cited(spark, folder), supplements(spark, folder)
    return V.manifest_statistics(sources(spark), A.events(spark, folder), more, V.used_sources([(o, "source_id", "source_ids"), (more, "source_id", None)], sources(spark)))
