"""Queries of fixed-weight and technology scoring, data integration, validation and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import numeric, text
from veldt.operators import enrich as N
from veldt.operators import fixedweight as W
from veldt.operators import graph as G
from veldt.operators import merge as M
from veldt.operators import serving as V
from veldt.operators import technology as T
from veldt.operators import validate as R
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.registry import query
from veldt.sources import adapter as A

EPS = "CAST(2.220446049250313e-16 AS DOUBLE)"


def up_eps(x: str, d: int) -> str:
    return f"floor((({x}) + {EPS}) * CAST({10**d} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**d} AS DOUBLE)"


# ---- assessments: every supplier with the 18 fixed-weight indicators, one in seven missing

ASSESSMENTS = f"""{O.COMPANIES},
fixed(indicator_id, dimension_id, weight) AS (VALUES {C.as_values(C.FIXED_WEIGHTS)}),
fixed_dims(dimension_id, dimension_weight) AS (VALUES {C.as_values(C.FIXED_DIMENSIONS)}),
numbered AS (SELECT *, row_number() OVER (ORDER BY indicator_id) AS k FROM fixed),
assessments AS (
  SELECT company_id, indicator_id, dimension_id, weight, CASE WHEN (s_suppkey + k) % 7 <> 0 THEN CAST((s_suppkey * 37 + k * 11) % 101 AS DOUBLE) END AS risk_score,
    CASE WHEN k % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST('0.75' AS DOUBLE) END AS coverage_factor, CASE WHEN k % 3 = 0 THEN CAST('0.5' AS DOUBLE) ELSE CAST('0.875' AS DOUBLE) END AS evidence_confidence,
    (s_suppkey + k) % 4 AS n_evidence, s_suppkey, k FROM companies CROSS JOIN numbered)"""

FIXED = f"""{ASSESSMENTS},
sums AS (SELECT company_id, sum(CASE WHEN risk_score IS NOT NULL THEN weight * risk_score END) AS total, coalesce(sum(CASE WHEN risk_score IS NOT NULL THEN weight END), 0) AS sw,
  coalesce(sum(CASE WHEN risk_score IS NOT NULL AND n_evidence > 0 THEN weight * coverage_factor END), 0) AS covered,
  coalesce(sum(CASE WHEN risk_score IS NOT NULL AND n_evidence > 0 THEN weight * evidence_confidence END), 0) AS confident, count(*) FILTER (risk_score IS NULL) AS missing FROM assessments GROUP BY 1),
base AS (SELECT company_id, {up_eps("total / nullif(sw, 0)", 4)} AS baseline_score, CAST(sw AS BIGINT) AS scored_weight, {up_eps("sw / CAST(100 AS DOUBLE)", 4)} AS weight_coverage,
  {up_eps("covered / CAST(100 AS DOUBLE)", 4)} AS evidence_coverage, {up_eps("confident / CAST(100 AS DOUBLE)", 4)} AS confidence, missing FROM sums),
fdims AS (SELECT company_id, dimension_id, {up_eps("sum(CASE WHEN risk_score IS NOT NULL THEN weight * risk_score END) / nullif(sum(CASE WHEN risk_score IS NOT NULL THEN weight END), 0)", 4)} AS score,
  CAST(coalesce(sum(CASE WHEN risk_score IS NOT NULL THEN weight END), 0) AS BIGINT) AS scored_weight, max(dimension_weight) AS dw FROM assessments JOIN fixed_dims USING (dimension_id) GROUP BY 1, 2)"""

LEVEL = "CASE WHEN {0} < 25 THEN 'low' WHEN {0} < 50 THEN 'medium' WHEN {0} < 75 THEN 'high' WHEN {0} IS NOT NULL THEN 'critical' END".format


def assessments(spark, folder, each: int = 5000):
    """18 rows a company, made by a task for about `each` companies."""
    names = [i for i, _, _ in sorted(C.FIXED_WEIGHTS)]
    fixed = C.fixed_weights(spark).withColumn("k", F.array_position(F.array(*map(F.lit, names)), F.col("indicator_id")))
    c = A.spread(A.companies(spark, folder), A.supplier_count(spark, folder), each, "company_id").join(F.broadcast(fixed), F.lit(True))
    key, k = F.col("s_suppkey"), F.col("k")
    return c.select(
        "company_id", "indicator_id", "dimension_id", "weight", F.when((key + k) % 7 != 0, ((key * 37 + k * 11) % 101).cast("double")).alias("risk_score"),
        F.when(k % 2 == 0, 1.0).otherwise(0.75).alias("coverage_factor"), F.when(k % 3 == 0, 0.5).otherwise(0.875).alias("evidence_confidence"),
        ((key + k) % 4).alias("n_evidence"), "s_suppkey", "k",
    )


@query(f"""WITH {FIXED} SELECT company_id, baseline_score, {LEVEL("baseline_score")} AS risk_level, scored_weight, weight_coverage, evidence_coverage, confidence, missing,
  CASE WHEN baseline_score IS NULL THEN 'insufficient-data' WHEN missing > 0 THEN 'partial' ELSE 'scored' END AS status FROM base""")
def fixed_weight_score(spark, folder):
    return W.baseline(assessments(spark, folder))


@query(f"WITH {FIXED} SELECT company_id, dimension_id, score, scored_weight, {up_eps('scored_weight / CAST(dw AS DOUBLE)', 4)} AS coverage FROM fdims")
def fixed_weight_dimensions(spark, folder):
    return W.dimensions(assessments(spark, folder), C.fixed_dimensions(spark))


@query(f"""WITH {ASSESSMENTS} SELECT company_id, indicator_id, {up_eps("weight * risk_score / nullif(sum(CASE WHEN risk_score IS NOT NULL THEN weight END) OVER (PARTITION BY company_id), 0)", 4)} AS contribution FROM assessments""")
def fixed_weight_contribution(spark, folder):
    return W.contributions(assessments(spark, folder))


@query(f"""WITH {FIXED}, e AS (SELECT company_id, count(*) FILTER (score IS NULL) AS empty_dimensions FROM fdims GROUP BY 1)
SELECT company_id, baseline_score, empty_dimensions, CASE WHEN baseline_score IS NULL THEN 'insufficient-data' WHEN evidence_coverage >= CAST('0.7' AS DOUBLE) AND empty_dimensions = 0 THEN 'ready' ELSE 'manual-review' END AS review_status FROM base JOIN e USING (company_id)""")
def review_status(spark, folder):
    a = assessments(spark, folder)
    return W.review_status(W.baseline(a), W.dimensions(a, C.fixed_dimensions(spark))).select("company_id", "baseline_score", "empty_dimensions", "review_status")


_PRESETS = C.as_values([(p, d, w) for p, ws in C.PRESETS.items() for (d, _), w in zip(C.FIXED_DIMENSIONS, ws, strict=True)])


@query(f"""WITH {FIXED}, presets(preset_id, dimension_id, preset_weight) AS (VALUES {_PRESETS}),
s AS (SELECT company_id, preset_id, sum(preset_weight * score) / sum(preset_weight) AS s FROM fdims JOIN presets USING (dimension_id) WHERE score IS NOT NULL GROUP BY 1, 2)
SELECT company_id, preset_id, round({up_eps("s", 4)}, 3) AS scenario_score, round({up_eps("s - baseline_score", 4)}, 3) AS delta FROM s JOIN base USING (company_id)""")
def scenario_scores(spark, folder):
    a = assessments(spark, folder)
    out = W.scenarios(W.dimensions(a, C.fixed_dimensions(spark)), C.presets(spark), W.baseline(a))
    return out.withColumns({c: F.round(c, 3) for c in ("scenario_score", "delta")})


@query(f"""WITH {O.COMPANIES}, c AS (SELECT 'path-' || s_suppkey AS path_id, CAST(s_suppkey % 100 AS DOUBLE) AS risk,
  CAST(1 AS DOUBLE) * (s_suppkey % 5 / CAST(4 AS DOUBLE)) * (s_suppkey % 3 / CAST(2 AS DOUBLE)) * (s_suppkey % 9 / CAST(8 AS DOUBLE)) * CAST('0.5' AS DOUBLE) * CAST(1 AS DOUBLE) * CAST('0.25' AS DOUBLE) AS raw FROM companies),
k AS (SELECT path_id, risk, {up_eps("raw", 6)} AS coefficient FROM c)
SELECT path_id, coefficient, {up_eps("risk * coefficient", 4)} AS candidate_risk, coefficient >= CAST('0.05' AS DOUBLE) AS included FROM k""")
def propagation_paths(spark, folder):
    key = F.col("s_suppkey")
    edge = lambda a, b, c: F.struct(a.alias("strength"), b.alias("time_decay"), c.alias("business_relevance"))
    paths = A.companies(spark, folder).select(
        F.concat(F.lit("path-"), key).alias("path_id"), (key % 100).cast("double").alias("event_risk_score"),
        F.array(edge(key % 5 / 4.0, key % 3 / 2.0, key % 9 / 8.0), edge(F.lit(0.5), F.lit(1.0), F.lit(0.25))).alias("edges"),
    )
    return W.propagation(paths)


_SEVERITY = "CASE WHEN value >= 30 THEN 'critical' WHEN value >= 20 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'watch' END"


def flagged(spark, folder):
    v = F.col("value")
    return A.events(spark, folder).withColumn(
        "severity", F.when(v >= 30, "critical").when(v >= 20, "high").when(v >= 10, "medium").otherwise("watch")
    ).withColumn("status", F.when(F.col("event_id") % 3 == 0, "done").when(F.col("event_id") % 3 == 1, "open").otherwise("watching"))


_FLAGGED = f"""{O.EVENTS}, flagged AS (SELECT *, {_SEVERITY} AS severity, CASE event_id % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'open' ELSE 'watching' END AS status FROM risk_events)"""


@query(f"""WITH {_FLAGGED}, r AS (SELECT event_id, CASE WHEN severity IN ('critical', 'high') THEN 'P0' ELSE 'P1' END AS priority, CAST(event_date AS DATE) AS day,
  CASE event_id % 5 WHEN 0 THEN 'technology' WHEN 1 THEN 'compliance' WHEN 2 THEN 'finance' WHEN 3 THEN 'external' ELSE 'governance' END AS owner FROM flagged WHERE severity <> 'watch')
SELECT event_id, priority, owner, strftime(day + CASE WHEN priority = 'P0' THEN 7 ELSE 14 END, '%Y-%m-%d') AS due FROM r""")
def red_flag_tasks(spark, folder):
    letters = F.array(*map(F.lit, ("T01", "C01", "F01", "E01", "P01")))
    e = flagged(spark, folder).withColumn("red_flag", F.col("severity") != "watch").withColumn("indicator_id", F.get(letters, (F.col("event_id") % 5).cast("int")))
    return W.tasks(W.red_flags(e), F.col("event_date").cast("date"))


# ---- technology

_TECH = f"""{O.COMPANIES}, n AS (SELECT company_id, s_suppkey, CAST(s_suppkey % 101 AS DOUBLE) AS a, CAST((s_suppkey * 7) % 101 AS DOUBLE) AS b, CAST((s_suppkey * 13) % 101 AS DOUBLE) AS c, CAST((s_suppkey * 29) % 101 AS DOUBLE) AS d FROM companies),
raw AS (SELECT company_id, s_suppkey, u.* FROM n, LATERAL (VALUES
  ('kci-006', 100 - a),
  ('kci-007', 100 - (CAST('0.30' AS DOUBLE) * a + CAST('0.20' AS DOUBLE) * b + CAST('0.25' AS DOUBLE) * c + CAST('0.25' AS DOUBLE) * d)),
  ('kci-008', 100 - (CAST('0.35' AS DOUBLE) * a + CAST('0.25' AS DOUBLE) * b + CAST('0.20' AS DOUBLE) * c + CAST('0.20' AS DOUBLE) * d)),
  ('kci-009', 100 - (CAST('0.4' AS DOUBLE) * a + CAST('0.6' AS DOUBLE) * b)),
  ('kci-010', 100 - (CAST('0.6' AS DOUBLE) * greatest(0, 100 - 25 * greatest(0, (1 + s_suppkey % 9) - (1 + s_suppkey % 7))) + CAST('0.4' AS DOUBLE) * 100 * ((s_suppkey % 11) / CAST(10 AS DOUBLE)))),
  ('kci-011', CASE WHEN s_suppkey % 4 <> 0 THEN 100 - 100 * (a / 100) END),
  ('kci-013', 100 * ((s_suppkey % 6 + 2 * (s_suppkey % 2)) / CAST(8 AS DOUBLE)))) u(indicator_id, x)),
risks AS (SELECT company_id, s_suppkey, indicator_id, CASE WHEN x IS NOT NULL THEN floor(least(greatest(x, 0), 100) * 100 + CAST('0.5' AS DOUBLE)) / CAST(100 AS DOUBLE) END AS risk FROM raw),
tw(indicator_id, weight) AS (VALUES {C.as_values(C.TECHNOLOGY_WEIGHTS)}),
tb AS (SELECT company_id, sum(weight) AS coverage, sum(weight * risk) AS total FROM risks JOIN tw USING (indicator_id) WHERE risk IS NOT NULL GROUP BY 1),
tbase AS (SELECT company_id, CAST(coverage AS BIGINT) AS coverage, CASE WHEN coverage >= 70 THEN floor(least(greatest(total / coverage, 0), 100) * 100 + CAST('0.5' AS DOUBLE)) / CAST(100 AS DOUBLE) END AS base_score FROM tb)"""


def technology_risks(spark, folder):
    n = A.companies(spark, folder).select("company_id", "s_suppkey")
    key = F.col("s_suppkey")
    a, b, c, d = (((key * m) % 101).cast("double") for m in (1, 7, 13, 29))
    no = F.lit(False)
    found = {
        "kci-006": T.two_digits(100 - a), "kci-007": T.citation_risk(a, b, c, d, no, no), "kci-008": T.patent_risk(a, b, c, d),
        "kci-009": T.investment_risk(a, b), "kci-010": T.readiness_risk(1 + key % 7, 1 + key % 9, key % 11, F.lit(10)),
        "kci-011": F.when(key % 4 != 0, T.conversion_risk(a, F.lit(100))), "kci-013": T.dependency_risk(key % 6, key % 2, F.lit(4), F.lit(2)),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("indicator_id"), x.cast("double").alias("risk")) for i, x in found.items())))
    return n.select("company_id", rows.alias("r")).select("company_id", "r.*")


def _tech_weights(spark):
    return spark.createDataFrame(C.TECHNOLOGY_WEIGHTS, "indicator_id string, weight int")


@query(f"WITH {_TECH} SELECT company_id, indicator_id, round(risk, 1) AS risk FROM risks")
def technology_indicator_risk(spark, folder):
    return technology_risks(spark, folder).withColumn("risk", F.round("risk", 1))


@query(f"WITH {_TECH} SELECT company_id, coverage, round(base_score, 1) AS base_score FROM tbase")
def technology_base_score(spark, folder):
    return T.base_score(technology_risks(spark, folder), _tech_weights(spark)).withColumn("base_score", F.round("base_score", 1))


_INCIDENTS = f"""{O.EVENTS}, inc AS (SELECT company_id, event_id, CAST(trunc(value) AS BIGINT) % 11 AS severity, CASE event_id % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' ELSE 'related' END AS responsibility,
  greatest(0, (2026 - CAST(substr(event_date, 1, 4) AS INT)) * 12 + 8 - CAST(substr(event_date, 6, 2) AS INT)) AS months FROM risk_events WHERE kind = 'screening'),
idx AS (SELECT *, floor(least(greatest(severity * CASE responsibility WHEN 'primary' THEN CAST(1 AS DOUBLE) WHEN 'secondary' THEN CAST('0.5' AS DOUBLE) ELSE CAST('0.25' AS DOUBLE) END *
  CASE WHEN months <= 12 THEN CAST(1 AS DOUBLE) WHEN months <= 24 THEN CAST('0.7' AS DOUBLE) WHEN months <= 36 THEN CAST('0.4' AS DOUBLE) ELSE CAST('0.2' AS DOUBLE) END, 0), 100) * 100 + CAST('0.5' AS DOUBLE)) / CAST(100 AS DOUBLE) AS i FROM inc),
worst AS (SELECT company_id, arg_max(event_id, i * 1000000000 - event_id) AS incident_id, max(i) AS incident_index, bool_or(severity >= 8 AND responsibility = 'primary') AS forced FROM idx GROUP BY 1)"""


@query(f"""WITH {_INCIDENTS} SELECT company_id, incident_id, incident_index, CASE WHEN incident_index <= 0 THEN 0 WHEN incident_index <= 2 THEN 40 WHEN incident_index <= 5 THEN 60 ELSE 85 END AS floor, forced FROM worst""")
def incident_overlay(spark, folder):
    e = A.events(spark, folder).where("kind = 'screening'")
    by = F.col("event_id") % 3
    inc = e.withColumn("severity", F.col("value").cast("long") % 11).withColumn("responsibility", F.when(by == 0, "primary").when(by == 1, "secondary").otherwise("related"))
    index = T.incident_index(F.col("severity"), F.col("responsibility"), F.col("event_date").cast("date"), F.lit("2026-08-01").cast("date"))
    inc = inc.select("company_id", F.col("event_id").alias("position"), F.col("event_id").alias("incident_id"), index.alias("index"), "severity", "responsibility", F.lit(False).alias("concealed"), F.lit(False).alias("repeated"))
    return T.incident_overlay(inc)


_RULES = C.as_values(C.THRESHOLD_RULES)
_HOLD = "CASE {1} WHEN '>' THEN {0} > {2} WHEN '>=' THEN {0} >= {2} WHEN '<' THEN {0} < {2} WHEN '<=' THEN {0} <= {2} ELSE {0} = {2} END".format


@query(f"""WITH {O.COMPANIES}, rules(rule_id, low_op, low, medium_op, medium) AS (VALUES {_RULES}),
v AS (SELECT company_id AS entity, rule_id, CASE WHEN s_suppkey % 6 <> 0 THEN CAST((s_suppkey * 17) % 140 - 15 AS DOUBLE) END AS value, low_op, low, medium_op, medium FROM companies CROSS JOIN rules)
SELECT entity, rule_id, value, CASE WHEN value IS NULL THEN NULL WHEN {_HOLD("value", "low_op", "low")} THEN 25 WHEN {_HOLD("value", "medium_op", "medium")} THEN 60 ELSE 85 END AS score FROM v""")
def threshold_rules(spark, folder):
    key = F.col("s_suppkey")
    rules = C.threshold_rules(spark)
    v = A.companies(spark, folder).join(F.broadcast(rules.select("rule_id")), F.lit(True)).select(
        F.col("company_id").alias("entity"), "rule_id", F.when(key % 6 != 0, ((key * 17) % 140 - 15).cast("double")).alias("value")
    )
    return T.banded(v, rules)


# ---- integration

_MERGED = """dbs AS (
  SELECT s_suppkey AS source_key, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_name AS name, 'suppliers' AS source_db, 0 AS priority FROM supplier
  UNION ALL SELECT c_custkey, lpad(CAST(c_custkey // 2 AS VARCHAR), 6, '0'), c_name, 'customers', 1 FROM customer),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY priority, source_key) AS k FROM dbs) WHERE k = 1)"""


def databases(spark, folder):
    code = lambda c: F.lpad(c.cast("string"), 6, "0")
    s = A.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("source_key"), code(F.col("s_suppkey")).alias("code"), F.col("s_name").alias("name"))
    c = A.table(spark, folder, "customer").select(F.col("c_custkey").alias("source_key"), code(F.floor(F.col("c_custkey") / 2).cast("long")).alias("code"), F.col("c_name").alias("name"))
    return M.by_priority([("suppliers", s), ("customers", c)])


@query(f"WITH {_MERGED} SELECT code, name, source_db, priority, source_key FROM kept")
def priority_dedup(spark, folder):
    return M.first_wins(databases(spark, folder), ["code"], ["priority", "source_key"]).select("code", "name", "source_db", "priority", "source_key")


@query(f"WITH {_MERGED} SELECT d.code, d.name, k.name AS kept_id, d.priority, d.source_key FROM dbs d JOIN kept k ON d.code = k.code WHERE d.priority <> k.priority OR d.source_key <> k.source_key")
def duplicate_map(spark, folder):
    return M.duplicates(databases(spark, folder), ["code"], ["priority", "source_key"], "name")


@query(f"WITH {_MERGED} SELECT code, source_db, 1000 + row_number() OVER (ORDER BY priority, source_key) AS key FROM kept")
def surrogate_keys(spark, folder):
    kept = M.first_wins(databases(spark, folder), ["code"], ["priority", "source_key"])
    return M.surrogate_keys(kept, ["priority", "source_key"], 1000).select("code", "source_db", "key")


@query(f"WITH {_MERGED} SELECT 'company' AS table_name, code AS target_key, source_db, source_key FROM dbs")
def merge_lineage(spark, folder):
    return M.lineage(databases(spark, folder), "company", "code", "source_key")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS d, o_custkey FROM orders)
SELECT o_custkey, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM o) WHERE k = 1""")
def upsert_last_wins(spark, folder):
    o = A.table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    changes = o.withColumn("version", F.col("o_orderkey").cast("long") + 1)
    return M.upserted(o.limit(0), changes, ["o_custkey"])


@query("""SELECT n_name, r_name AS label, count(s_suppkey) AS companies, coalesce(sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS negative
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def directory_view(spark, folder):
    n, r, s = (A.table(spark, folder, t) for t in ("nation", "region", "supplier"))
    groups = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("peer_group_id"), "n_name", F.col("r_name").alias("label"))  # regions are five rows
    companies = s.select(F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").alias("peer_group_id"), (F.col("s_acctbal") < 0).alias("flagged"))
    return V.directory(groups, companies).select("n_name", "label", "companies", F.col("flagged").alias("negative"))


_COVERAGE = f"""{O.EVENTS}, seen AS (SELECT company_id, kind, count(*) AS n FROM risk_events GROUP BY 1, 2),
kinds AS (SELECT DISTINCT kind FROM risk_events), {O.COMPANIES},
coverage AS (SELECT c.company_id, peer_group_id, k.kind, CASE WHEN n IS NULL THEN 'NA-none' ELSE 'available' END AS status, coalesce(n, 0) AS n
  FROM companies c CROSS JOIN kinds k LEFT JOIN seen s ON s.company_id = c.company_id AND s.kind = k.kind)"""


def coverage(spark, folder):
    e = A.events(spark, folder)
    seen = e.groupBy("company_id", "kind").agg(F.count("*").alias("n"))
    pairs = A.companies(spark, folder).join(F.broadcast(e.select("kind").distinct()), F.lit(True))
    out = pairs.join(seen, ["company_id", "kind"], "left")
    return out.select("company_id", "peer_group_id", "kind", F.when(F.col("n").isNull(), "NA-none").otherwise("available").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_COVERAGE} SELECT peer_group_id, kind, status, count(*) AS rows, sum(CASE WHEN status LIKE 'NA%' THEN 0 ELSE 1 END)::BIGINT AS usable FROM coverage GROUP BY 1, 2, 3")
def coverage_summary(spark, folder):
    return V.coverage_summary(coverage(spark, folder), ["peer_group_id", "kind", "status"])


@query(f"WITH {_COVERAGE} SELECT peer_group_id, kind AS indicator_id, count(*) AS companies FROM coverage GROUP BY 1, 2 HAVING bool_and(status NOT LIKE 'NA%')")
def score_ready_indicators(spark, folder):
    c = coverage(spark, folder).select("company_id", F.col("kind").alias("indicator_id"), (~text.not_applicable(F.col("status"))).alias("usable"))
    return M.score_ready(c, A.companies(spark, folder).select("company_id", "peer_group_id")).select("peer_group_id", "indicator_id", "companies")


# ---- validation

@query("""WITH l AS (SELECT l_orderkey, l_linenumber FROM lineitem)
SELECT 'duplicate-line' AS rule, l_orderkey || '|' || l_linenumber AS entity FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'negative-balance', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'order-customer', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 1000 NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'empty-name', s_name FROM supplier WHERE trim(s_name) = ''""")
def integrity_violations(spark, folder):
    t = lambda n: A.table(spark, folder, n)
    orders = t("orders").select("o_orderkey", (F.col("o_custkey") % 1000).alias("s"))
    return R.all_of(
        R.unique(t("lineitem"), ["l_orderkey", "l_linenumber"], "duplicate-line"), R.check(t("supplier"), F.col("s_acctbal") < 0, "negative-balance", "s_suppkey"),
        R.references(orders, "s", t("supplier"), "s_suppkey", "order-customer", "o_orderkey"), R.not_empty(t("supplier"), "s_name", "empty-name", "s_name"),
    )


@query(f"WITH {_COVERAGE} SELECT 'coverage-absent' AS rule, c.company_id || '|' || k.kind AS entity FROM companies c CROSS JOIN kinds k WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.company_id = c.company_id AND s.kind = k.kind)")
def coverage_violations(spark, folder):
    e = A.events(spark, folder)
    return R.complete(e.select("company_id", "kind"), A.companies(spark, folder), e, ("company_id", "kind"), "coverage-absent")


@query("""WITH a AS (SELECT DISTINCT o_custkey % 200 AS x FROM orders), b AS (SELECT s_suppkey AS x FROM supplier)
SELECT 'keys:missing' AS rule, CAST(x AS VARCHAR) AS entity FROM a WHERE x NOT IN (SELECT x FROM b) UNION ALL SELECT 'keys:unexpected', CAST(x AS VARCHAR) FROM b WHERE x NOT IN (SELECT x FROM a)""")
def set_equality(spark, folder):
    a = A.table(spark, folder, "orders").select((F.col("o_custkey") % 200).alias("x"))
    return R.set_equal(a, A.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("x")), "x", "keys")


# ---- events, feeds, trends

@query(f"WITH {_FLAGGED} SELECT event_id, kind, event_date, severity, status, title FROM flagged WHERE severity = 'high' AND status = 'open' AND contains(lower(concat_ws(' ', title, kind, company_id, event_date)), 'user 1')")
def event_register(spark, folder):
    return V.event_register(flagged(spark, folder), "high", "open", "USER 1").select("event_id", "kind", "event_date", "severity", "status", "title")


@query(f"""WITH {_FLAGGED}, m AS (SELECT strftime(CAST('2023-09-01' AS DATE) + to_months(CAST(i AS INTEGER)), '%Y-%m') AS month FROM range(6) t(i))
SELECT m.month, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(event_id) AS total FROM m LEFT JOIN flagged ON substr(event_date, 1, 7) = m.month GROUP BY 1""")
def monthly_trend(spark, folder):
    return V.monthly_trend(flagged(spark, folder), "2024-02-15", 6)


@query(f"WITH {_FLAGGED} SELECT company_id, count(*) AS events, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'open') AS open, floor(100 * count(*) FILTER (status = 'done') / CAST(count(*) AS DOUBLE) + CAST('0.5' AS DOUBLE))::BIGINT AS response_rate FROM flagged GROUP BY 1")
def event_status_summary(spark, folder):
    return V.status_summary(flagged(spark, folder))


@query(f"WITH {_FLAGGED}, {O.COMPANIES} SELECT event_id, title, short_name, event_date, kind AS category FROM flagged JOIN companies USING (company_id) WHERE kind = 'screening' AND event_date >= '2024-01-10' ORDER BY event_date DESC, event_id LIMIT 18")
def signal_feed(spark, folder):
    s = flagged(spark, folder).join(A.companies(spark, folder).select("company_id", "short_name"), "company_id").withColumn("category", F.col("kind"))
    return V.feed(s, category="screening", since="2024-01-10").select("event_id", "title", "short_name", "event_date", "category")


@query(f"WITH {_FLAGGED} SELECT event_id, event_date, kind FROM flagged WHERE event_date >= '2024-01-15' AND event_date <= '2024-04-15'")
def recent_events(spark, folder):
    return V.recent(flagged(spark, folder), "2024-04-15", 3).select("event_id", "event_date", "kind")


@query(f"WITH {_FLAGGED} SELECT company_id, event_id, event_date, k FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, event_id) AS k FROM flagged) WHERE k <= 4")
def latest_four_events(spark, folder):
    return V.top_k(flagged(spark, folder), ["company_id"], [F.col("event_date").desc(), F.col("event_id")], 4).select("company_id", "event_id", "event_date", "k")


@query(f"""WITH {O.COMPANIES} SELECT company_id, benchmark_group, coalesce(lead(company_id) OVER w, first_value(company_id) OVER (PARTITION BY benchmark_group ORDER BY company_id)) AS next_company_id
FROM companies WINDOW w AS (PARTITION BY benchmark_group ORDER BY company_id)""")
def next_peer(spark, folder):
    return V.next_peer(A.companies(spark, folder))


@query("""SELECT '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || CASE WHEN regexp_matches(CAST(c_nationkey - 12 AS VARCHAR), '^[=+@-]') THEN '''' ELSE '' END || (c_nationkey - 12) || '"' AS line FROM customer""")
def csv_export(spark, folder):
    c = A.table(spark, folder, "customer")
    return V.csv_lines(c.select("c_custkey", "c_name", (F.col("c_nationkey") - 12).alias("balance")))


# ---- graph

_GRAPH = f"""{_COVERAGE},
edges AS (SELECT 'company:' || company_id AS source, 'event:' || event_id AS target, 'event' AS kind FROM risk_events
  UNION ALL SELECT 'company:' || company_id, 'category:' || kind, 'structure' FROM companies CROSS JOIN kinds)"""


def graph_edges_of(spark, folder):
    e = A.events(spark, folder)
    met = e.select(F.concat(F.lit("company:"), "company_id").alias("source"), F.concat(F.lit("event:"), "event_id").alias("target"), F.lit("event").alias("kind"))
    own = A.companies(spark, folder).join(F.broadcast(e.select("kind").distinct()), F.lit(True)).select(
        F.concat(F.lit("company:"), "company_id").alias("source"), F.concat(F.lit("category:"), "kind").alias("target"), F.lit("structure").alias("kind")
    )
    return met.unionByName(own)


@query(f"WITH {_GRAPH} SELECT source, target, kind FROM edges")
def graph_edges(spark, folder):
    return graph_edges_of(spark, folder)


@query(f"WITH {_GRAPH}, ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE target <> source) SELECT id, count(*) AS degree FROM ends GROUP BY 1")
def node_degree(spark, folder):
    return G.degrees(graph_edges_of(spark, folder))


@query(f"WITH {_GRAPH} SELECT source, target, kind FROM edges WHERE source = 'company:star-000003' OR target = 'company:star-000003'")
def ego_graph_edges(spark, folder):
    e = graph_edges_of(spark, folder)
    nodes = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return G.ego(nodes, e, "company:star-000003")[1]


# ---- documents, numbers, text

@query("""SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources,
  floor(count(*) FILTER (toxic = 1) * CAST(100 AS DOUBLE) / greatest(count(*), 1) * 1000000 + CAST('0.5' AS DOUBLE)) / 1000000 AS toxic_share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def news_metrics(spark, folder):
    d = A.table(spark, folder, "documents").select("doc_id", "lang", "source").join(A.table(spark, folder, "labels"), "doc_id", "left")
    items = d.select(F.col("lang").alias("company_id"), F.when(F.col("toxic") == 1, "negative").alias("sentiment"), F.lit(False).alias("keyword"), F.col("source").alias("media_name"))
    return N.news(items).select(F.col("company_id").alias("lang"), F.col("n").alias("documents"), F.col("media").alias("sources"), F.col("negative_share").alias("toxic_share"))


@query(f"""WITH {_FLAGGED} SELECT company_id, count(*) AS clues, string_agg(event_id::VARCHAR, ',' ORDER BY event_date DESC, event_id::VARCHAR) FILTER (k <= 3) AS excerpt
FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY event_date DESC, event_id::VARCHAR) AS k FROM flagged WHERE regexp_matches(title, 'purchase|view')) GROUP BY 1""")
def clue_excerpts(spark, folder):
    e = flagged(spark, folder).select("company_id", "title", F.lit("").alias("summary"), F.col("event_date").alias("date"), F.col("event_id").cast("string").alias("label"))
    return N.clues(e, "purchase|view", 3, "label", ",")


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1""")
def nested_extraction(spark, folder):
    e = A.table(spark, folder, "events").withColumn("k", N.nested_number(F.col("props"), "$.k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


@query("""SELECT s_suppkey, greatest(least(s_acctbal, 100), 0) AS clamped, CASE WHEN s_acctbal / 10000 >= CAST('0.85' AS DOUBLE) THEN '高' WHEN s_acctbal / 10000 >= CAST('0.6' AS DOUBLE) THEN '中' ELSE '低' END AS label,
  floor(s_acctbal + CAST('0.5' AS DOUBLE))::BIGINT AS rounded FROM supplier""")
def numeric_functions(spark, folder):
    b = F.col("s_acctbal")
    return A.table(spark, folder, "supplier").select(
        "s_suppkey", numeric.clamp(b, 0, 100).alias("clamped"), numeric.confidence_label(b / 10000).alias("label"), F.floor(b + 0.5).alias("rounded")
    )


_PERIODS = [
    ("2026-Q2", 20260631), ("2026 q3", 20260931), ("2025年", 20251231), ("2024年度", 20241231), ("2024年业绩", 20241231), ("2025年上半年", 20250631), ("2025h1", 20250631), (" 2025-03-07 ", 20250307),
    ("2025年3月7日", 20250307), ("2024年第四季度", 20241231), ("2024-02", 20240231), ("2025H2", 20251231), ("2025年1-6月", 20250631), ("on 2025-03-07 at noon", None), ("soon", None),
]


@query(f"WITH p(period, key) AS (VALUES {C.as_values(_PERIODS)}) SELECT s_suppkey, period, key FROM supplier CROSS JOIN p WHERE s_suppkey < 3")
def period_keys(spark, folder):
    rows = spark.createDataFrame([(p,) for p, _ in _PERIODS], "period string")
    s = A.table(spark, folder, "supplier").where("s_suppkey < 3").select("s_suppkey")
    return s.join(F.broadcast(rows), F.lit(True)).select("s_suppkey", "period", text.period_key(F.col("period")).alias("key"))


@query("""SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'events', count(*) FROM events""")
def table_counts(spark, folder):
    return M.union_all([A.table(spark, folder, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")).select("name", "n") for t in ("region", "nation", "supplier", "events")])
