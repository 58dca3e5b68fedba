"""Queries of the assessment graph, of canonical requests and run identifiers, and of orders by locale and by input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veldt.functions import canonical as J
from veldt.operators import assessment_graph as G
from veldt.operators import ordered as R
from veldt.plans import catalogue as C
from veldt.plans.risk_queries import _FLAGGED, FIXED, LEVEL, assessments, fixed_weight_dimensions, fixed_weight_score, flagged
from veldt.registry import query
from veldt.sources import adapter as A
from veldt.sources.snapshots import written

_NAMES = [i for i, _, _ in sorted(C.FIXED_WEIGHTS)]
_DIMS = [d for d, _ in C.FIXED_DIMENSIONS]
HASHED = 250  # companies whose requests a task writes and hashes, some 8 ms each
_FIVE = ("T01", "C01", "F01", "E01", "P01")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _number(x: str) -> str:
    """A double with at most 4 decimals as ECMAScript prints it."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '[.]0$', '')"


_SUPPORT = "['direct', 'inferred', 'background']"
_PARTS = f"""{FIXED}, {_FLAGGED},
a_head AS (SELECT b.company_id, c.short_name AS label, baseline_score AS score, {LEVEL("baseline_score")} AS level, DATE '2024-07-01' AS as_of FROM base b JOIN companies c USING (company_id)),
a_dims AS (SELECT company_id, dimension_id, 'Dimension ' || dimension_id AS label, score, {LEVEL("score")} AS level, list_position({_list(_DIMS)}, dimension_id) AS place FROM fdims),
a_ind AS (SELECT company_id, s_suppkey, indicator_id, dimension_id, weight, 'Indicator ' || indicator_id AS label, risk_score AS score, {LEVEL("risk_score")} AS level, k AS place, n_evidence FROM assessments),
a_all AS (SELECT company_id, indicator_id, 'EV-' || s_suppkey || '-' || ((place + j) % 5) AS evidence_id, {_SUPPORT}[(place + j) % 3 + 1] AS support, 'p. ' || place AS locator, 'basis ' || j AS inference_basis,
  DATE '2024-01-01' + CAST((s_suppkey * 7 + place) % 300 AS INTEGER) AS valid_from, CASE WHEN place % 2 = 1 THEN DATE '2024-01-01' + CAST((s_suppkey * 7 + place) % 300 + 100 AS INTEGER) END AS valid_to
  FROM a_ind, range(3) t(j) WHERE j < n_evidence),
a_ref AS (SELECT a_all.* FROM a_all JOIN a_head USING (company_id) WHERE as_of >= valid_from AND (valid_to IS NULL OR as_of < valid_to)),
a_cat AS (SELECT company_id, 'EV-' || s_suppkey || '-' || i AS evidence_id, 'Evidence ' || i AS title, 'Source ' || (s_suppkey % 3) AS source_name, i AS place FROM companies, range(5) t(i)),
a_red AS (SELECT company_id, CAST(event_id AS VARCHAR) AS event_id, title, severity, CASE WHEN severity IN ('critical', 'high') THEN 'P0' ELSE 'P1' END AS priority,
  [{_list(_FIVE)}[event_id % 5 + 1], {_list(_FIVE)}[(event_id + 2) % 5 + 1]] AS indicator_ids, ['EV-' || s_suppkey || '-' || (event_id % 5)] AS evidence_ids, event_id AS place FROM flagged WHERE severity <> 'watch' AND company_id IN (SELECT company_id FROM companies)),
a_path AS (SELECT company_id, 'path-' || event_id AS path_id, CAST(event_id AS VARCHAR) AS event_id, event_id % 8 = 0 AS included, 'trace ' || event_id AS trace FROM flagged WHERE event_id % 4 = 0),
a_eventdims AS (SELECT company_id, event_id, string_agg(dimension_id, ',' ORDER BY p) AS dims FROM (SELECT company_id, event_id, dimension_id, min(p) AS p FROM (SELECT company_id, event_id, unnest(indicator_ids) AS indicator_id, generate_subscripts(indicator_ids, 1) AS p FROM a_red) JOIN fixed USING (indicator_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
a_proofdims AS (SELECT company_id, evidence_id, string_agg(dimension_id, ',' ORDER BY p) AS dims FROM (SELECT company_id, evidence_id, dimension_id, min(place) AS p FROM a_ref JOIN a_ind USING (company_id, indicator_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
g_nodes AS (
  SELECT company_id, 'company:' || company_id AS id, 'company' AS kind, label, coalesce({_number("score")}, '—') || ' 分 · ' || coalesce(map{{'low': '低', 'medium': '中', 'high': '高', 'critical': '极高'}}[level], '数据不足') || '风险' AS caption, score, coalesce(level, 'neutral') AS tone, '{",".join(_DIMS)}' AS dimension_ids, 0 AS place FROM a_head
  UNION ALL SELECT company_id, 'dimension:' || dimension_id, 'dimension', label, coalesce({_number("score")}, '—') || ' 分 · ' || coalesce(map{{'low': '低', 'medium': '中', 'high': '高', 'critical': '极高'}}[level], '数据不足') || '风险', score, coalesce(level, 'neutral'), dimension_id, place FROM a_dims
  UNION ALL SELECT company_id, 'indicator:' || indicator_id, 'indicator', label, indicator_id || ' · ' || coalesce({_number("score")}, '—') || ' 分', score, coalesce(level, 'neutral'), dimension_id, place FROM a_ind
  UNION ALL SELECT company_id, 'event:' || event_id, 'event', title, priority || ' · 独立红旗', NULL, CASE WHEN severity IN ('critical', 'high') THEN severity ELSE 'medium' END, coalesce(dims, ''), place FROM a_red LEFT JOIN a_eventdims USING (company_id, event_id)
  UNION ALL SELECT company_id, 'evidence:' || evidence_id, 'evidence', title, evidence_id || ' · ' || source_name, NULL, 'neutral', coalesce(dims, ''), place FROM a_cat LEFT JOIN a_proofdims USING (company_id, evidence_id)),
g_edges AS (
  SELECT company_id, 'structure:' || company_id || ':' || dimension_id AS id, 'company:' || company_id AS source, 'dimension:' || dimension_id AS target, 'structure' AS kind, '评估维度' AS label, 'KCR V3 固定五维结构' AS detail FROM a_dims
  UNION ALL SELECT company_id, 'structure:' || dimension_id || ':' || indicator_id, 'dimension:' || dimension_id, 'indicator:' || indicator_id, 'structure', '包含指标', '固定权重 ' || weight FROM a_ind
  UNION ALL SELECT company_id, 'evidence:' || indicator_id || ':' || evidence_id || ':' || support, 'indicator:' || indicator_id, 'evidence:' || evidence_id, support, CASE support WHEN 'direct' THEN '直接支持' WHEN 'inferred' THEN '推断支持' ELSE '背景核验' END, CASE support WHEN 'inferred' THEN inference_basis ELSE locator END FROM a_ref
  UNION ALL SELECT company_id, 'event-indicator:' || event_id || ':' || i, 'indicator:' || i, 'event:' || event_id, 'event-link', '关联红旗', '评分输入记录的事件—指标关联，不表示新增因果判断' FROM (SELECT company_id, event_id, unnest(indicator_ids) AS i FROM a_red)
  UNION ALL SELECT company_id, 'event-evidence:' || event_id || ':' || e, 'event:' || event_id, 'evidence:' || e, 'event-link', '事件来源', '评分输入记录的红旗事件证据' FROM (SELECT company_id, event_id, unnest(evidence_ids) AS e FROM a_red)
  UNION ALL SELECT company_id, 'propagation:' || path_id, 'event:' || event_id, 'company:' || company_id, 'propagation', '风险传播', trace FROM a_path SEMI JOIN a_red USING (company_id, event_id) WHERE included)"""


def assessed_parts(spark, folder) -> dict:
    """The tables of an assessment, from the fixed-weight scores and the red flags of the given tables."""
    a = assessments(spark, folder)
    level = lambda c: F.when(F.col(c) < 25, "low").when(F.col(c) < 50, "medium").when(F.col(c) < 75, "high").when(F.col(c).isNotNull(), "critical")
    names = A.companies(spark, folder).select("company_id", "short_name")
    head = fixed_weight_score(spark, folder).join(names, "company_id").select("company_id", F.col("short_name").alias("label"), F.col("baseline_score").alias("score"), level("baseline_score").alias("level"), F.lit("2024-07-01").cast("date").alias("as_of"))
    dims = fixed_weight_dimensions(spark, folder).select(
        "company_id", "dimension_id", F.concat(F.lit("Dimension "), "dimension_id").alias("label"), "score", level("score").alias("level"), F.array_position(F.array(*map(F.lit, _DIMS)), F.col("dimension_id")).alias("place")
    )
    indicators = a.select("company_id", "s_suppkey", "indicator_id", "dimension_id", "weight", F.concat(F.lit("Indicator "), "indicator_id").alias("label"), F.col("risk_score").alias("score"), level("risk_score").alias("level"), F.col("k").alias("place"), "n_evidence")
    j, place, key = F.col("j"), F.col("place"), F.col("s_suppkey")
    proof = lambda n: F.concat_ws("-", F.lit("EV"), key, n)
    start = F.date_add(F.lit("2024-01-01").cast("date"), ((key * 7 + place) % 300).cast("int"))
    every = indicators.where("n_evidence > 0").withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("n_evidence") - 1).cast("int")))).select(
        "company_id", "indicator_id", proof((place + j) % 5).alias("evidence_id"), F.get(F.array(*map(F.lit, G.EVIDENCE_KINDS)), ((place + j) % 3).cast("int")).alias("support"),
        F.concat(F.lit("p. "), place).alias("locator"), F.concat(F.lit("basis "), j).alias("inference_basis"), start.alias("valid_from"), F.when(place % 2 == 1, F.date_add(start, 100)).alias("valid_to"),
    )
    catalogue = A.companies(spark, folder).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "company_id", proof(F.col("place")).alias("evidence_id"), F.concat(F.lit("Evidence "), "place").alias("title"), F.concat(F.lit("Source "), key % 3).alias("source_name"), "place"
    )
    e, i = flagged(spark, folder).withColumn("s_suppkey", F.expr("cast(substring(company_id, 6) as long)")), F.col("event_id")
    five = F.array(*map(F.lit, _FIVE))
    red = e.where("severity <> 'watch'").join(names, "company_id", "left_semi").select(
        "company_id", i.cast("string").alias("event_id"), "title", "severity", F.when(F.col("severity").isin("critical", "high"), "P0").otherwise("P1").alias("priority"),
        F.array(F.get(five, (i % 5).cast("int")), F.get(five, ((i + 2) % 5).cast("int"))).alias("indicator_ids"), F.array(proof(i % 5)).alias("evidence_ids"), i.alias("place"),
    )
    paths = e.where(i % 4 == 0).select("company_id", F.concat(F.lit("path-"), i).alias("path_id"), i.cast("string").alias("event_id"), (i % 8 == 0).alias("included"), F.concat(F.lit("trace "), i).alias("trace"))
    return {"head": head, "dims": dims, "indicators": indicators, "references": G.in_force(every, head), "catalogue": catalogue, "red": red, "paths": paths}


def graph_nodes(p: dict):
    return G.nodes(p["head"], p["dims"], p["indicators"], p["red"], p["references"], p["catalogue"])


def graph_edges(p: dict):
    return G.edges(p["dims"], p["indicators"], p["references"], p["red"], p["paths"])


def graph_of(spark, folder):
    """Nodes and edges, written: views read both several times, and as cached plans every stage of a view had the whole chain's tasks and metrics."""
    p = assessed_parts(spark, folder)
    return written(graph_nodes(p), "graph_nodes"), written(graph_edges(p), "graph_edges")


def _flat(nodes):
    return nodes.select("company_id", "id", "kind", "label", "caption", "score", "tone", F.concat_ws(",", "dimension_ids").alias("dimension_ids"))


@query(f"WITH {_PARTS} SELECT company_id, id, kind, label, caption, score, tone, dimension_ids FROM g_nodes")
def assessment_graph_nodes(spark, folder):
    return _flat(graph_nodes(assessed_parts(spark, folder)))


@query(f"WITH {_PARTS} SELECT * FROM g_edges")
def assessment_graph_edges(spark, folder):
    return graph_edges(assessed_parts(spark, folder))


@query(f"""WITH {_PARTS}, n AS (SELECT company_id, count(*) AS nodes FROM g_nodes GROUP BY 1), e AS (SELECT company_id, count(*) AS edges, count(*) FILTER (kind = 'direct') AS direct_evidence, count(*) FILTER (kind = 'inferred') AS inferred_evidence,
  count(*) FILTER (kind = 'background') AS background_evidence, count(*) FILTER (kind = 'propagation') AS propagation_paths FROM g_edges GROUP BY 1) SELECT * FROM n JOIN e USING (company_id)""")
def assessment_graph_counts(spark, folder):
    return G.counts(*graph_of(spark, folder))


_SHOWN = f"""{_PARTS}, shown AS (SELECT company_id, id FROM g_nodes WHERE kind = 'company' OR id = 'dimension:compliance' OR (kind <> 'evidence' AND list_contains(string_split(dimension_ids, ','), 'compliance'))
  UNION SELECT company_id, target FROM g_edges WHERE source = 'indicator:C01' AND target LIKE 'evidence:%')"""


@query(f"""WITH {_SHOWN} SELECT g.company_id, g.id, g.source, g.target, g.kind FROM g_edges g JOIN shown a ON g.company_id = a.company_id AND source = a.id JOIN shown b ON g.company_id = b.company_id AND target = b.id
  WHERE NOT (source LIKE 'evidence:%' OR target LIKE 'evidence:%') OR source = 'indicator:C01' OR target = 'indicator:C01'""")
def assessment_dimension_edges(spark, folder):
    return G.dimension_view(*graph_of(spark, folder), "compliance", "indicator:C01")[1].select("company_id", "id", "source", "target", "kind")


@query(f"""WITH {_PARTS}, kinds AS (SELECT company_id, id FROM g_nodes WHERE kind IN ('company', 'dimension', 'event'))
SELECT g.company_id, g.id, g.kind FROM g_edges g JOIN kinds a ON g.company_id = a.company_id AND source = a.id JOIN kinds b ON g.company_id = b.company_id AND target = b.id""")
def assessment_overview_edges(spark, folder):
    return G.overview(*graph_of(spark, folder))[1].select("company_id", "id", "kind")


@query(f"""WITH {_PARTS}, start AS (SELECT company_id, 'event:' || min(place) AS id FROM a_red GROUP BY 1),
met AS (SELECT company_id, id FROM start UNION SELECT company_id, id FROM g_nodes WHERE kind = 'company'
  UNION SELECT g.company_id, unnest([source, target]) FROM g_edges g JOIN start s ON g.company_id = s.company_id AND (source = s.id OR target = s.id) WHERE kind IN ('event-link', 'propagation')),
dims AS (SELECT * FROM met UNION SELECT n.company_id, 'dimension:' || unnest(string_split(dimension_ids, ',')) FROM g_nodes n JOIN met USING (company_id, id) WHERE kind IN ('indicator', 'event') AND dimension_ids <> ''),
proof AS (SELECT * FROM dims UNION SELECT g.company_id, target FROM g_edges g JOIN dims d ON g.company_id = d.company_id AND source = d.id WHERE kind IN ('direct', 'inferred', 'background'))
SELECT company_id, id, kind FROM g_nodes JOIN proof USING (company_id, id)""")
def assessment_event_lineage(spark, folder):
    return G.lineage(*graph_of(spark, folder))[0].select("company_id", "id", "kind")


# ---- canonical requests and identifiers of runs

_HASHED = """u AS (SELECT *, list_transform(string_split(request, ''), lambda c: CAST(unicode(c) AS BIGINT)) AS units FROM r),
h AS (SELECT *, list_reduce(units, lambda h, c: (xor(h, c) * 16777619) % 4294967296, CAST(2166136261 AS BIGINT)) AS left_hash,
  list_reduce(units, lambda h, c: CAST(CAST(xor(h, c) AS HUGEINT) * 2246822507 % 4294967296 AS BIGINT), CAST(2654435769 AS BIGINT)) AS right_hash FROM u)"""


@query(f"""WITH {FIXED}, r AS (SELECT company_id, indicator_id, weight, '{{"asOf":"2024-07-01","company":{{"id":"' || company_id || '","name":"企业 \\"' || s_suppkey || '\\""}},"flags":[true,' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '],"id":"' || indicator_id || '","risk_score":'
    || coalesce({_number("risk_score")}, 'null') || ',"small":' || {_number("(s_suppkey % 8) / CAST(8 AS DOUBLE)")} || ',"weights":{{"coverage":' || {_number("coverage_factor")} || ',"weight":' || weight || '}}}}' AS request FROM assessments), {_HASHED}
SELECT company_id, indicator_id, request, 'kcr3-' || printf('%08x', left_hash) AS assessment_run, 'ktr-' || printf('%08x', left_hash) || printf('%08x', right_hash) AS technology_run,
  'tqb-' || lower(to_base(1719792000000 + weight * 1000, 36)) || '-' || company_id AS baseline_run FROM h""")
def run_ids(spark, folder):
    key = F.col("s_suppkey")
    a = assessments(spark, folder, HASHED).select(
        "company_id", "indicator_id", "weight",
        F.struct(
            F.create_map(F.lit("weight"), F.col("weight").cast("double"), F.lit("coverage"), F.col("coverage_factor")).alias("weights"), "risk_score", ((key % 8) / 8.0).alias("small"), F.col("indicator_id").alias("id"),
            F.array(F.lit(True), F.col("k") % 2 == 0).alias("flags"), F.lit("2024-07-01").cast("date").alias("asOf"), F.struct(F.concat(F.lit('企业 "'), key, F.lit('"')).alias("name"), F.col("company_id").alias("id")).alias("company"),
        ).alias("request"),
    )
    at = F.timestamp_millis(F.lit(1719792000000) + F.col("weight") * 1000)
    text = a.select("company_id", "indicator_id", J.canonical_json(F.col("request"), a.schema["request"].dataType).alias("request"), J.baseline_run_id(at, F.col("company_id")).alias("baseline_run"))
    return text.select("*", J.assessment_run_id(F.col("request")).alias("assessment_run"), J.technology_run_id(F.col("request")).alias("technology_run"))


# ---- orders

_TOWNS = ("Öhringen", "Ohlau", "ähnlich", "Zwickau", "apfel", "Straße", "Strasse", "北京", "上海", "阿里", "重庆", "长沙")


def _named(spark, folder):
    town = reduce(lambda out, it: out.when(F.col("c_custkey") % len(_TOWNS) == it[0], it[1]), list(enumerate(_TOWNS))[1:], F.when(F.col("c_custkey") % len(_TOWNS) == 0, _TOWNS[0]))
    return A.table(spark, folder, "customer").select("c_custkey", "c_mktsegment", F.concat(town, F.lit(" "), F.col("c_custkey") % 3).alias("name"))


_NAMED = f"named AS (SELECT c_custkey, c_mktsegment, {_list(_TOWNS)}[c_custkey % {len(_TOWNS)} + 1] || ' ' || (c_custkey % 3) AS name FROM customer)"


@query(f"""WITH {_NAMED} SELECT c_custkey, name, rank() OVER (PARTITION BY c_mktsegment ORDER BY name COLLATE de) AS german, rank() OVER (PARTITION BY c_mktsegment ORDER BY name COLLATE zh) AS chinese,
  rank() OVER (PARTITION BY c_mktsegment ORDER BY name) AS by_code FROM named""")
def locale_order(spark, folder):
    ranked = R.locale_ranked(R.locale_ranked(_named(spark, folder), "name", "de_DE", ["c_mktsegment"], "german"), "name", "zh", ["c_mktsegment"], "chinese")
    return R.locale_ranked(ranked, "name", "UTF8_BINARY", ["c_mktsegment"], "by_code").select("c_custkey", "name", "german", "chinese", "by_code")


@query("""WITH p AS (SELECT *, row_number() OVER () AS pos FROM (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders)),
f AS (SELECT o_custkey, o_orderpriority, min(pos) AS pos FROM p GROUP BY 1, 2), s AS (SELECT o_custkey, first(o_orderstatus ORDER BY pos) AS first_status FROM p GROUP BY 1)
SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY pos) AS priorities, any_value(first_status) AS first_status FROM f JOIN s USING (o_custkey) GROUP BY 1""")
def first_seen_priorities(spark, folder):
    o = R.scanned(spark, f"{folder}/orders.parquet", ["o_custkey", "o_orderpriority", "o_orderstatus"])
    seen = R.distinct_in_order(o, ["o_custkey"], "o_orderpriority", "priorities")
    first = R.first_seen(o.drop("o_orderpriority"), ["o_custkey"]).select("o_custkey", F.col("o_orderstatus").alias("first_status"))
    return seen.join(first, "o_custkey").withColumn("priorities", F.concat_ws(",", "priorities"))
