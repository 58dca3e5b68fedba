"""Queries of events, evidence governance and company views."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import numeric, text
from veldt.operators import enrich as N
from veldt.operators import events as E
from veldt.operators import graph as G
from veldt.operators import merge as M
from veldt.operators import scoring as S
from veldt.operators import technology as T
from veldt.operators import views as V
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.plans.risk_queries import _COVERAGE, _INCIDENTS, _TECH, _tech_weights, coverage, incident_overlay, technology_risks
from veldt.plans.scoring_queries import industry_scores
from veldt.registry import query
from veldt.sources import adapter as A

_TYPES = ("处罚决定", "项目延期", "结项公告", "行业会议", "诉讼进展", "产品发布", "重大合同")
_SOURCES = (("公告", "上交所"), ("年报", "公司"), ("官方名单", "联邦公报"), ("新闻", "Wind"), ("报告", "天眼查专业版"), ("论文", "期刊"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- events of the star schema with the texts that normalisation reads

_RAW = f"""{O.EVENTS}, raw AS (SELECT *, {_list(_TYPES)}[event_id % 7 + 1] AS event_type, CASE WHEN event_id % 4 <> 0 THEN 'note ' || event_id ELSE '' END AS notes, 'R' || lpad(CAST(1 + event_id % 22 AS VARCHAR), 2, '0') AS indicator_id,
  CASE event_id % 5 WHEN 0 THEN 'https://www.sse.com.cn/' ELSE 'https://news.example/' END || event_id AS url, (event_id % 20) / CAST(20 AS DOUBLE) AS confidence, {_list(a for a, _ in _SOURCES)}[event_id % 6 + 1] AS source_type, {_list(b for _, b in _SOURCES)}[event_id % 6 + 1] AS institution,
  ['direct', 'inferred', 'background'][event_id % 3 + 1] AS strength, CASE WHEN event_id % 2 = 0 THEN 'stated' ELSE ' ' END AS basis FROM risk_events),
graded AS (SELECT *, CASE WHEN kind = 'screening' OR regexp_matches(event_type || title, '处罚|调查|重大|负面|诉讼|仲裁|无效|泄露') THEN 'high' WHEN kind IN ('inquiry', 'litigation') THEN 'medium' ELSE 'watch' END AS severity,
  CASE WHEN regexp_matches(event_type, '处罚|调查') THEN 'critical' WHEN regexp_matches(event_type, '延期|诉讼|仲裁') THEN 'high' WHEN contains(event_type, '结项') THEN 'low' ELSE 'medium' END AS tone FROM raw),
signals AS (SELECT 'signal:' || event_id AS signal_id, event_id, company_id, severity, event_date, url, title,
  CASE WHEN kind IN ('screening', 'litigation') THEN '监管政策' WHEN kind = 'inquiry' THEN '资本市场' WHEN indicator_id = 'R09' THEN '技术论文/专利' ELSE '企业披露' END AS category,
  coalesce(nullif(notes, ''), event_type) AS summary, CASE severity WHEN 'high' THEN 90 WHEN 'medium' THEN 65 ELSE 40 END AS heat,
  CASE WHEN contains(url, 'sse.com.cn') THEN 'exchange' WHEN kind = 'screening' THEN 'official' ELSE 'media' END AS reliability, CASE WHEN confidence >= CAST('0.85' AS DOUBLE) THEN 'verified' ELSE 'monitoring' END AS verification FROM graded)"""


def raw_events(spark, folder):
    i = F.col("event_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (i % n).cast("int"))
    return A.events(spark, folder).select(
        "*", pick(_TYPES, 7).alias("event_type"), F.when(i % 4 != 0, F.concat(F.lit("note "), i)).otherwise("").alias("notes"), F.concat(F.lit("R"), F.lpad((1 + i % 22).cast("string"), 2, "0")).alias("indicator_id"),
        F.concat(F.when(i % 5 == 0, "https://www.sse.com.cn/").otherwise("https://news.example/"), i).alias("url"), ((i % 20) / 20.0).alias("confidence"), pick([a for a, _ in _SOURCES], 6).alias("source_type"),
        pick([b for _, b in _SOURCES], 6).alias("institution"), pick(("direct", "inferred", "background"), 3).alias("strength"), F.when(i % 2 == 0, "stated").otherwise(" ").alias("basis"),
    )


@query(f"WITH {_RAW} SELECT event_id, severity, tone FROM graded")
def event_grades(spark, folder):
    return raw_events(spark, folder).select("event_id", E.severity(F.col("kind"), F.col("event_type"), F.col("title")).alias("severity"), E.event_tone(F.col("event_type")).alias("tone"))


@query(f"WITH {_RAW} SELECT signal_id, company_id, category, severity, summary, heat, reliability, verification FROM signals")
def event_signals(spark, folder):
    return E.signals(raw_events(spark, folder)).select("signal_id", "company_id", "category", "severity", "summary", "heat", "reliability", "verification")


@query(f"""WITH {_RAW} SELECT (SELECT count(*) FROM signals) AS signals, (SELECT count(*) FROM signals WHERE verification <> 'verified') AS pending, (SELECT count(DISTINCT company_id) FROM signals WHERE severity = 'high') AS high_companies,
  (SELECT string_agg(signal_id, ',' ORDER BY event_date DESC, event_id) FROM (SELECT * FROM signals WHERE severity = 'high' ORDER BY event_date DESC, event_id LIMIT 10)) AS priority_signals""")
def daily_brief(spark, folder):
    return E.brief(E.signals(raw_events(spark, folder)))


@query(f"""WITH {_RAW} SELECT company_id, signal_id, title, severity, CASE WHEN event_id % 9 = 0 THEN 'done' ELSE 'open' END AS status FROM signals WHERE event_id % 9 = 0 OR severity = 'high'""")
def promoted_events(spark, folder):
    s = E.signals(raw_events(spark, folder))
    known = s.where("event_id % 9 = 0").select("company_id", "signal_id", "title", "severity", F.lit("done").alias("status"), "event_date")
    high = s.where("severity = 'high'")
    return E.promoted(known, high.unionByName(high.where("event_id % 2 = 0"))).drop("event_date")


@query(f"WITH {_RAW} SELECT category, severity, verification, count(*) AS n FROM signals GROUP BY 1, 2, 3")
def signal_admission_counts(spark, folder):
    return E.signals(raw_events(spark, folder)).groupBy("category", "severity", "verification").agg(F.count("*").alias("n"))


_VENDOR = "'Wind|同花顺|天眼查|企查查|智慧芽|PatSnap|incoPat|IT桔子|IT 桔子|烯牛|慧博'"
_GOVERNED = f"""{_RAW}, governed AS (SELECT event_id, institution, strength, CASE WHEN regexp_matches(source_type || ' ' || institution, '上交所|交易所') THEN 'exchange' WHEN regexp_matches(source_type || ' ' || institution, '年报|定期报告|招股') THEN 'filing'
    WHEN regexp_matches(source_type || ' ' || institution, '政府|监管|官方|联邦公报|清单') THEN 'official' ELSE 'media' END AS reliability, regexp_matches(institution, {_VENDOR}) AS candidate,
  NOT regexp_matches(institution, {_VENDOR}) AND (strength = 'direct' OR (strength = 'inferred' AND trim(basis) <> '')) AS effective FROM raw)"""


def governed(spark, folder):
    e = raw_events(spark, folder)
    name = F.col("institution")
    return e.select(
        "event_id", "company_id", "institution", "strength", E.reliability(F.col("source_type"), name).alias("reliability"), E.candidate_source(name).alias("candidate"), E.effective(name, F.col("strength"), F.col("basis")).alias("effective")
    )


@query(f"WITH {_GOVERNED} SELECT event_id, institution, strength, reliability, candidate, effective FROM governed")
def evidence_governance(spark, folder):
    return governed(spark, folder).drop("company_id")


@query(f"WITH {_GOVERNED} SELECT event_id, reliability FROM governed WHERE reliability <> 'media'")
def official_evidence(spark, folder):
    return V.official(governed(spark, folder)).select("event_id", "reliability")


@query(f"WITH {_GOVERNED} SELECT event_id, strength FROM governed WHERE effective AND event_id % 3 <> 2 AND event_id % 7 <> 0")
def registered_references(spark, folder):
    g = governed(spark, folder).withColumn("evidence_id", F.col("event_id"))
    registry = E.registry(g.where("effective"), g.where("event_id % 7 <> 0").select("evidence_id", "company_id"))
    wrong = F.when(F.col("event_id") % 3 == 2, "other").otherwise(F.col("strength"))
    return E.referenced(g.select("event_id", "evidence_id", "company_id", wrong.alias("strength")), registry).select("event_id", "strength")


@query(f"WITH {_RAW} SELECT signal_id, 'e' || event_id AS evidence_id FROM signals WHERE event_id % 2 = 0")
def signals_by_address(spark, folder):
    e = raw_events(spark, folder)
    return E.by_url(E.signals(e), e.where("event_id % 2 = 0").select(F.concat(F.lit("e"), "event_id").alias("evidence_id"), "url"))


# ---- files, periods, identifiers

_FILES = (
    "/a/公司风险指标.xlsx", "/a/可审计工作簿.XLSX", "2024年报.pdf", "财务报表.xlsx", "专利清单.xlsx", "客户名单.xlsx", "立案信息.xlsx", "资质证书.pdf", "融资历史.xlsx", "股东信息.xlsx", "全部材料.ZIP", "简介.pdf", "年报与专利.pdf",
)
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{v}'" for p, v in N.CATEGORIES[:-1]) + " ELSE 'company-profile' END"
_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{v}'" for p, v in N.CLASSES[:-1]) + " ELSE 'commercial-data-export' END"


@query(f"WITH f AS (SELECT 'supplier-' || s_suppkey || '/' || {_list(_FILES)}[s_suppkey % {len(_FILES)} + 1] AS path FROM supplier) SELECT path, {_CATEGORY} AS category, {_CLASS} AS class, lower(regexp_extract(path, '[.]([A-Za-z]+)$', 1)) AS format FROM f")
def file_catalogue(spark, folder):
    key = F.col("s_suppkey")
    name = F.get(F.array(*map(F.lit, _FILES)), (key % len(_FILES)).cast("int"))
    return N.catalogued(A.table(spark, folder, "supplier").select(F.concat(F.lit("supplier-"), key, F.lit("/"), name).alias("path")))


_PATHS = (
    ("C:\\Users\\me\\data\\x.csv", "external-source/x.csv"), ("/Users/me/work/geng/raw/y.json", "external-source/raw/y.json"), ("file at /home/me/z.txt", "file at user-home/z.txt"),
    ("/tmp/stays.txt", "/tmp/stays.txt"), ("https://e.example/home", "https://e.example/home"), ("/home/me/a/geng/b", "external-source/b"),
)


@query(f"""WITH p(i, path, portable) AS (VALUES {C.as_values([(i, *x) for i, x in enumerate(_PATHS)])}), q AS (SELECT path || '-' || s_suppkey AS path, portable || '-' || s_suppkey AS portable FROM supplier JOIN p ON s_suppkey % {len(_PATHS)} = i)
SELECT path, portable, path LIKE '/Users/%' OR path LIKE '% /home/%' OR path LIKE '/home/%' OR path LIKE 'C:%' AS local FROM q""")
def portable_paths(spark, folder):
    key = F.col("s_suppkey")
    path = F.get(F.array(*(F.lit(a) for a, _ in _PATHS)), (key % len(_PATHS)).cast("int"))
    p = A.table(spark, folder, "supplier").select(F.concat(path, F.lit("-"), key).alias("path"))
    return p.select("path", text.portable_path(F.col("path")).alias("portable"), text.local_path(F.col("path")).alias("local"))


# ---- company views

_GROUPS = ("digital-chip", "analog-chip", "pharma", "robots", None)
_CODES = ("688012", "688347", "000001")


def _sql_group(peer: str, code: str) -> str:
    return f"CASE WHEN {peer} IN ('digital-chip', 'analog-chip') THEN 'chip-design' WHEN {peer} = 'pharma' THEN 'chemical-pharma' WHEN {code} IN ('688012', '688037', '688072') THEN 'semiconductor-equipment' WHEN {code} IN ('688347', '688981') THEN 'integrated-circuit-manufacturing' ELSE coalesce({peer}, 'unclassified') END"


@query(f"""WITH c AS (SELECT s_suppkey, ['digital-chip', 'analog-chip', 'pharma', 'robots', NULL][s_suppkey % 5 + 1] AS peer, {_list(_CODES)}[s_suppkey % 3 + 1] AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'segment' ELSE '' END AS segment, CASE WHEN s_suppkey % 4 = 1 THEN 'industry' END AS industry FROM supplier),
g AS (SELECT *, {_sql_group('peer', 'code')} AS benchmark_group FROM c)
SELECT s_suppkey, benchmark_group, CASE benchmark_group WHEN 'chip-design' THEN '芯片（数字+模拟芯片设计）' WHEN 'chemical-pharma' THEN '化学制剂' WHEN 'semiconductor-equipment' THEN '半导体设备' WHEN 'integrated-circuit-manufacturing' THEN '集成电路制造'
  ELSE coalesce(nullif(segment, ''), nullif(industry, ''), '未分类行业') END AS label FROM g""")
def benchmark_groups(spark, folder):
    k = F.col("s_suppkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (k % n).cast("int"))
    c = A.table(spark, folder, "supplier").select(
        k, pick(_GROUPS, 5).alias("peer"), pick(_CODES, 3).alias("code"), F.when(k % 2 == 0, "segment").otherwise("").alias("segment"), F.when(k % 4 == 1, "industry").alias("industry")
    )
    c = c.withColumn("benchmark_group", V.benchmark_group(F.col("peer"), F.col("code")))
    return c.select("s_suppkey", "benchmark_group", V.group_label(F.col("benchmark_group"), F.col("segment"), F.col("industry")).alias("label"))


_ASSESSED = f"""{O.totals('critic')},
usable AS (SELECT company_id, count(*) FILTER (kind <> 'litigation') AS n FROM risk_events GROUP BY 1),
assessed AS (SELECT c.company_id, total_score AS score, coalesce(dimensions_scored, 0) AS assessable_dimensions, CASE WHEN total_score IS NULL THEN 'insufficient-evidence' ELSE 'manual-review' END AS review_status,
  CASE WHEN total_score >= 75 THEN 'critical' WHEN total_score >= 60 THEN 'high' WHEN total_score >= 40 THEN 'medium' WHEN total_score IS NOT NULL THEN 'low' END AS level,
  CAST(floor(coalesce(u.n, 0) * 100 / CAST(22 AS DOUBLE) + CAST('0.5' AS DOUBLE)) AS BIGINT) AS indicator_availability FROM companies c LEFT JOIN total t ON t.company_id = c.company_id LEFT JOIN usable u ON u.company_id = c.company_id)"""


def assessed(spark, folder):
    _, dims, _, totals = S.method_results(industry_scores(spark, folder), "critic")
    c = A.companies(spark, folder).select("company_id").join(totals.select("company_id", "total_score"), "company_id", "left")
    status = A.events(spark, folder).select("company_id", F.when(F.col("kind") == "litigation", "NA-litigation").otherwise("available").alias("status"))
    narrative = c.select("company_id", F.lit(None).cast("double").alias("narrative_index"))
    return V.base_assessment(dims, narrative, c, status)


@query(f"WITH {_ASSESSED} SELECT company_id, score, level, assessable_dimensions, indicator_availability, review_status FROM assessed")
def base_assessment(spark, folder):
    return assessed(spark, folder).drop("narrative_index")


@query(f"WITH {_ASSESSED} SELECT company_id, score FROM assessed WHERE score >= 60 OR (SELECT count(score) FROM assessed) = 0")
def risk_lens(spark, folder):
    return V.risk_lens(assessed(spark, folder), 60).select("company_id", "score")


@query(f"WITH {O.SCORES} SELECT indicator_id, count(*) AS companies, {O.half_up('avg(risk_score)', 2)} AS average FROM scores WHERE risk_score IS NOT NULL GROUP BY 1")
def indicator_averages(spark, folder):
    return V.indicator_averages(industry_scores(spark, folder))


_SOURCED = f"{_RAW}, sourced AS (SELECT company_id, indicator_id, institution AS source_id FROM raw WHERE event_id % 11 <> 0)"


def sourced(spark, folder):
    return raw_events(spark, folder).select("company_id", "indicator_id", F.when(F.col("event_id") % 11 != 0, F.col("institution")).alias("source_id"))


@query(f"""WITH {_SOURCED} SELECT indicator_id, NULL AS source_id, count(DISTINCT company_id) AS companies FROM sourced GROUP BY 1 UNION ALL SELECT NULL, source_id, count(DISTINCT company_id) FROM sourced GROUP BY source_id
UNION ALL SELECT indicator_id, source_id, count(DISTINCT company_id) FROM sourced GROUP BY 1, 2""")
def company_sets(spark, folder):
    return V.company_sets(sourced(spark, folder))


@query("""WITH o AS (SELECT o_orderkey AS observation_id, 'p' || o_orderpriority AS a, 's' || o_orderstatus AS b FROM orders), l AS (SELECT observation_id, a AS source_id FROM o UNION SELECT observation_id, b FROM o)
SELECT source_id, count(*) AS n, min(observation_id) AS first FROM l GROUP BY 1 UNION ALL SELECT 'unused', 0, NULL""")
def sources_with_observations(spark, folder):
    o = A.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("observation_id"), F.concat(F.lit("p"), "o_orderpriority").alias("source_id"), F.array(F.concat(F.lit("s"), "o_orderstatus"), F.concat(F.lit("p"), "o_orderpriority")).alias("source_ids")
    )
    sources = o.select(F.explode(F.concat(F.array("source_id"), "source_ids")).alias("source_id")).distinct().unionByName(spark.createDataFrame([("unused",)], "source_id string"))
    out = V.sources_with_observations(sources, o)
    return out.select("source_id", F.size("observation_ids").cast("long").alias("n"), F.get("observation_ids", F.lit(0)).alias("first"))


# ---- technology: all eight indicators, forced reasons

_FLAGS = """flags AS (SELECT company_id, s_suppkey % 19 = 0 AS f8, s_suppkey % 23 = 0 AS f9, s_suppkey % 29 = 0 AS f10, s_suppkey % 31 = 0 AS f12, s_suppkey % 37 = 0 AS single_source, s_suppkey % 41 = 0 AS export_restriction FROM companies)"""


def _all_risks(spark, folder):
    k = F.col("s_suppkey")
    own = A.companies(spark, folder).select("company_id", F.lit("kci-012").alias("indicator_id"), T.validation_risk(k % 4, k % 3, k % 2, k % 5, F.lit(12), k % 11, F.lit(10)).cast("double").alias("risk"))
    return technology_risks(spark, folder).unionByName(own)


@query(f"""WITH {_TECH}, v AS (SELECT company_id, 'kci-012' AS indicator_id, 100 - (CAST('0.4' AS DOUBLE) * (((s_suppkey % 4) + CAST('0.8' AS DOUBLE) * (s_suppkey % 3) + CAST('0.5' AS DOUBLE) * (s_suppkey % 2) + CAST('0.2' AS DOUBLE) * (s_suppkey % 5)) / CAST(12 AS DOUBLE) * 100) + CAST('0.6' AS DOUBLE) * 100 * ((s_suppkey % 11) / CAST(10 AS DOUBLE))) AS x FROM n),
every AS (SELECT company_id, indicator_id, risk FROM risks UNION ALL SELECT company_id, indicator_id, floor(least(greatest(x, 0), 100) * 100 + CAST('0.5' AS DOUBLE)) / CAST(100 AS DOUBLE) FROM v),
b AS (SELECT company_id, CAST(sum(weight) AS BIGINT) AS coverage, sum(weight * risk) AS total FROM every JOIN tw USING (indicator_id) WHERE risk IS NOT NULL GROUP BY 1),
base AS (SELECT company_id, coverage, CASE WHEN coverage >= 70 THEN floor(least(greatest(total / coverage, 0), 100) * 100 + CAST('0.5' AS DOUBLE)) / CAST(100 AS DOUBLE) END AS base_score FROM b),
{_INCIDENTS}, {_FLAGS}
SELECT base.company_id, coverage, round(base_score, 1) AS base_score, CASE WHEN base_score IS NOT NULL THEN round(greatest(base_score, coalesce(CASE WHEN incident_index <= 0 THEN 0 WHEN incident_index <= 2 THEN 40 WHEN incident_index <= 5 THEN 60 ELSE 85 END, 0),
  CASE WHEN coalesce(forced, false) OR f8 OR f9 OR f10 OR f12 OR single_source OR export_restriction THEN 85 ELSE 0 END), 1) END AS score
FROM base LEFT JOIN worst USING (company_id) JOIN flags USING (company_id)""")
def technology_final_score(spark, folder):
    k = F.col("s_suppkey")
    flags = A.companies(spark, folder).select(
        "company_id", (k % 19 == 0).alias("patent_failure"), (k % 23 == 0).alias("stale"), (k % 29 == 0).alias("self_assessed"), (k % 31 == 0).alias("safety_failure"),
        (k % 37 == 0).alias("single_source"), (k % 41 == 0).alias("export_restriction"), F.lit(None).cast("boolean").alias("license_risk"),
    )
    base = T.base_score(_all_risks(spark, folder), _tech_weights(spark))
    out = T.final_score(base, incident_overlay(spark, folder), T.forced_reasons(flags))
    return out.select("company_id", "coverage", F.round("base_score", 1).alias("base_score"), F.round("score", 1).alias("score"))


@query(f"""WITH {_COVERAGE}, {_FLAGS} SELECT company_id, concat_ws('；', CASE WHEN f8 THEN '核心专利大面积失效或无法覆盖主营产品' END, CASE WHEN f9 THEN '核心技术连续3年无有效更新' END, CASE WHEN f10 THEN 'TRL 仅为自评且缺少实验或示范证据' END, CASE WHEN f12 THEN '存在强制或安全关键测试失败' END,
  CASE WHEN single_source OR export_restriction THEN '关键技术外部依赖红旗：' || concat_ws('、', CASE WHEN single_source THEN '不可替代高影响单一来源' END, CASE WHEN export_restriction THEN '出口限制' END) END) AS reasons FROM flags""")
def forced_reasons(spark, folder):
    k = F.col("s_suppkey")
    flags = A.companies(spark, folder).select(
        "company_id", (k % 19 == 0).alias("patent_failure"), (k % 23 == 0).alias("stale"), (k % 29 == 0).alias("self_assessed"), (k % 31 == 0).alias("safety_failure"),
        (k % 37 == 0).alias("single_source"), (k % 41 == 0).alias("export_restriction"), F.lit(False).alias("license_risk"),
    )
    return T.forced_reasons(flags).select("company_id", F.array_join("reasons", "；").alias("reasons"))


# ---- graph counts, averages by category

@query(f"""WITH {_COVERAGE} SELECT 'node' AS element, 'company' AS kind, count(*) AS n FROM companies UNION ALL SELECT 'node', 'category', count(*) FROM kinds UNION ALL SELECT 'node', 'event', count(*) FROM risk_events
UNION ALL SELECT 'edge', 'structure', (SELECT count(*) FROM companies) * (SELECT count(*) FROM kinds) UNION ALL SELECT 'edge', 'event', count(*) FROM risk_events""")
def graph_counts(spark, folder):
    from veldt.plans.risk_queries import graph_edges_of

    e = graph_edges_of(spark, folder)
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("kind", F.substring_index("id", ":", 1))
    return V.kind_counts(nodes, e)


@query(f"""WITH {O.SCORES} SELECT company_id, dimension_id, {O.half_up('avg(risk_score)', 2)} AS category_score FROM scores WHERE risk_score IS NOT NULL GROUP BY 1, 2""")
def category_means(spark, folder):
    return G.category_means(industry_scores(spark, folder))


# ---- text, numbers and identifiers of the function library

@query("""WITH n AS (SELECT c_custkey, c_name || ' é企' || c_mktsegment AS s FROM customer)
SELECT c_custkey, s, printf('%08x', list_reduce(list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT))) AS fnv FROM n""")
def fnv1a_hashes(spark, folder):
    named = A.table(spark, folder, "customer").select("c_custkey", F.concat("c_name", F.lit(" é企"), "c_mktsegment").alias("s"))
    return named.select("c_custkey", "s", text.fnv1a(F.col("s")).alias("fnv"))


@query(r"""SELECT c_custkey, trim(c_name) AS name, nullif(trim(c_mktsegment), '') AS segment, 'segment:' || c_mktsegment AS spaced, c_mktsegment LIKE 'NA%' AS absent, regexp_replace(c_name, '\s+', ' ', 'g') AS plain,
  CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 11) || '…' ELSE c_name END AS short, CASE WHEN c_custkey % 30 BETWEEN 1 AND 22 THEN 'R' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') END AS indicator FROM customer""")
def text_functions(spark, folder):
    c = A.table(spark, folder, "customer")
    code = F.concat(F.lit("R"), F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"))
    return c.select(
        "c_custkey", F.trim("c_name").alias("name"), text.text_or_null(F.col("c_mktsegment")).alias("segment"), text.namespaced(F.lit("segment"), F.col("c_mktsegment")).alias("spaced"),
        text.not_applicable(F.col("c_mktsegment")).alias("absent"), text.collapse_spaces(F.col("c_name")).alias("plain"), text.ellipsis(F.col("c_name"), 12).alias("short"), text.indicator_or_null(code).alias("indicator"),
    )


@query("""SELECT o_orderkey, greatest(0, (1999 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) AS months, CASE WHEN greatest(0, (1999 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) <= 12 THEN 1
  WHEN greatest(0, (1999 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) <= 24 THEN 0.7 WHEN greatest(0, (1999 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) <= 36 THEN 0.4 ELSE 0.2 END::DOUBLE AS decay FROM orders""")
def age_decay(spark, folder):
    gap = numeric.month_gap(F.lit("1999-06-15").cast("date"), F.col("o_orderdate").cast("date"))
    return A.table(spark, folder, "orders").select("o_orderkey", gap.alias("months"), numeric.step_decay(gap).alias("decay"))


@query("""SELECT s_suppkey, 10 + (90 - 10) * CAST(s_suppkey % 5 AS DOUBLE) / 4 AS spaced, round(floor(10 * cos((s_suppkey % 5) * 2 * pi() / 5 - pi() / 2) * 100 + CAST('0.5' AS DOUBLE)) / 100, 2) AS x,
  round(floor(10 * sin((s_suppkey % 5) * 2 * pi() / 5 - pi() / 2) * 100 + CAST('0.5' AS DOUBLE)) / 100, 2) AS y FROM supplier""")
def axis_geometry(spark, folder):
    i = F.col("s_suppkey") % 5
    x, y = numeric.polar(F.lit(10.0), i, 5)
    return A.table(spark, folder, "supplier").select("s_suppkey", numeric.spacing(F.lit(10.0), F.lit(90.0), i.cast("double"), F.lit(5)).alias("spaced"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"))


# ---- integration

@query("""SELECT c_custkey, 1000 + c_nationkey AS nation_key FROM customer WHERE c_nationkey % 4 <> 0""")
def remapped_keys(spark, folder):
    mapping = A.table(spark, folder, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("old_key"), (1000 + F.col("n_nationkey")).alias("new_key"))
    facts = A.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return M.remapped(facts, mapping, "c_nationkey", "nation_key")


@query("""SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 7 = 0) OR n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0)""")
def used_sources(spark, folder):
    c = A.table(spark, folder, "customer").where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("n_nationkey"))
    s = A.table(spark, folder, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return M.used_only(A.table(spark, folder, "nation").select("n_nationkey"), [c, s], "n_nationkey")


@query("""SELECT o_custkey, min(o_orderkey) AS position, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1""")
def last_value_first_place(spark, folder):
    o = A.table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("position"), "o_orderstatus")
    return M.last_by_key(o, ["o_custkey"], "position")


@query(f"""WITH {_COVERAGE} SELECT company_id, kind AS indicator_id, CASE WHEN status LIKE 'NA%' AND company_id > 'star-000010' THEN 'found' ELSE status END AS status FROM coverage""")
def coverage_enriched(spark, folder):
    c = coverage(spark, folder).select("company_id", F.col("kind").alias("indicator_id"), "status")
    found = c.where("company_id > 'star-000010'").select("company_id", "indicator_id", F.lit("found").alias("status"))
    return N.coverage_filled(c, found)


# ---- scoring requests with planted mistakes

@query(f"""WITH {O.COMPANIES}, k AS (SELECT company_id, s_suppkey AS s FROM companies)
SELECT company_id, 'evidence-without-title-source-or-place' AS rule, 'e' || s AS entity FROM k WHERE s % 7 = 0 UNION ALL SELECT company_id, 'unknown-tier', 'e' || s FROM k WHERE s % 5 = 0 UNION ALL SELECT company_id, 'unsafe-url', 'e' || s FROM k WHERE s % 6 = 0
UNION ALL SELECT company_id, 'publication-blank', 'e' || s FROM k WHERE s % 11 = 0
UNION ALL SELECT company_id, 'event-without-title-or-summary', 'v' || s FROM k WHERE s % 8 = 0 UNION ALL SELECT company_id, 'unknown-severity', 'v' || s FROM k WHERE s % 9 = 0 UNION ALL SELECT company_id, 'event-of-unknown-indicator', 'v' || s FROM k WHERE s % 10 = 0
UNION ALL SELECT company_id, 'red-flag-without-evidence', 'v' || s FROM k WHERE s % 4 = 0 UNION ALL SELECT company_id, 'event-of-unknown-evidence', 'v' || s || '|nope' FROM k WHERE s % 4 = 1
UNION ALL SELECT company_id, 'path-of-unknown-event', 'p' || s FROM k WHERE s % 3 = 0 UNION ALL SELECT company_id, 'path-score-out-of-range', 'p' || s FROM k WHERE s % 13 = 0 UNION ALL SELECT company_id, 'unsound-edge', 'p' || s FROM k WHERE s % 17 = 0
UNION ALL SELECT company_id, 'status-against-coverage', 'T01' FROM k WHERE s % 12 = 0 UNION ALL SELECT company_id, 'reference-without-place', 'T01|e' || s FROM k WHERE s % 14 = 0
UNION ALL SELECT company_id, 'inference-without-basis', 'T01|e' || s FROM k WHERE s % 15 = 0 UNION ALL SELECT company_id, 'scored-without-evidence', 'T01' FROM k WHERE s % 15 = 0 UNION ALL SELECT company_id, 'method-version', company_id FROM k WHERE s % 16 = 0""")
def request_violations(spark, folder):
    from veldt.operators import request_rules as Q

    k = A.companies(spark, folder).select("company_id", "s_suppkey")
    s = F.col("s_suppkey")
    when = lambda n, bad, good: F.when(s % n == 0, bad).otherwise(good)
    name = lambda p: F.concat(F.lit(p), s)
    none = F.lit(None).cast("string")
    evidence = k.select(
        "company_id", name("e").alias("evidence_id"), when(7, "", "title").alias("title"), F.lit("source").alias("source_name"), F.lit("page 1").alias("locator"), when(5, "blog", "media").alias("source_tier"),
        when(6, "ftp://x", "https://e.example/").alias("url"), F.when(s % 11 == 0, " ").alias("published_at"),
    )
    ids = F.when(s % 4 == 0, F.array().cast("array<string>")).when(s % 4 == 1, F.array(F.lit("nope"))).otherwise(F.array(name("e")))
    events = k.select(
        "company_id", name("v").alias("event_id"), F.lit("title").alias("title"), when(8, " ", "summary").alias("summary"), when(9, "odd", "high").alias("severity"), F.lit(True).alias("red_flag"),
        F.array(when(10, "X99", "T01")).alias("source_indicator_ids"), ids.alias("evidence_ids"),
    )
    edge = F.struct(F.lit("r").alias("relation_id"), when(17, 1.5, 0.5).alias("strength"), F.lit(1.0).alias("time_decay"), F.lit(0.5).alias("business_relevance"))
    paths = k.select("company_id", name("p").alias("path_id"), F.when(s % 3 == 0, "none").otherwise(name("v")).alias("event_id"), when(13, 120.0, 50.0).alias("event_risk_score"), F.array(edge).alias("edges"))
    indicators = k.select("company_id", F.lit("T01").alias("indicator_id"), F.lit("partial").alias("data_status"), when(12, 1.0, 0.75).alias("coverage_factor"), F.lit(0.5).alias("evidence_confidence"), F.lit(10.0).alias("risk_score"))
    references = k.select("company_id", F.lit("T01").alias("indicator_id"), name("e").alias("evidence_id"), when(14, "", "page 2").alias("locator"), when(15, "inferred", "direct").alias("strength"), none.alias("basis"))
    header = k.select("company_id", when(16, "old", C.FIXED_METHOD_VERSION).alias("method_version"), F.lit("2026-08-01").alias("assessment_at"), F.lit("2026-07-31").alias("data_cutoff"))
    rules = [i for i, _, _ in C.FIXED_WEIGHTS]
    parts = (
        Q.header_errors(header), Q.evidence_errors(evidence), Q.status_errors(indicators), Q.reference_errors(references, evidence, indicators), Q.event_errors(events, evidence, rules), Q.path_errors(paths, events),
    )
    return M.union_all(list(parts))
