"""Queries of the rules of evidence catalogues and scoring workspaces, on mistakes planted in tables derived from the given ones.

A catalogue belongs to a nation: its companies are the suppliers there, its artifacts files of orders, classified by
their names. A workspace belongs to a customer: observations are its orders, bindings the lines of these.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import enrich as N
from veldt.operators import workspace_rules as W
from veldt.plans.event_queries import _CATEGORY, _FILES, _list
from veldt.registry import query
from veldt.sources import adapter as A


def evidence_catalogues(spark, folder):
    s, n, k = A.table(spark, folder, "supplier"), A.supplier_count(spark, folder), F.col("o_orderkey")
    nation = s.select(F.col("s_suppkey").alias("company_id"), F.col("s_nationkey").alias("catalogue_id"))
    name = F.get(F.array(*map(F.lit, _FILES)), (k % len(_FILES)).cast("int"))
    files = A.table(spark, folder, "orders").select(k, (k % n).alias("company_id"), F.concat(F.lit("/files/"), k, F.lit("-"), F.regexp_replace(name, "^/a/", "")).alias("path"))
    artifacts = N.catalogued(files).join(nation, "company_id").select(
        F.when(k % 997 == 3, F.lit(-1)).otherwise(F.col("catalogue_id")).alias("catalogue_id"), F.when(k % 211 == 5, 0).otherwise(k).alias("artifact_id"), F.when(k % 223 == 6, -5).otherwise(F.col("company_id")).alias("company_id"),
        F.when(k % 227 == 7, "other").otherwise(F.col("category")).alias("category"), "format", F.when(k % 229 == 8, "public").when(k % 233 != 9, W.REDISTRIBUTION).alias("redistribution"),
    )
    counted = artifacts.groupBy("catalogue_id", "company_id").agg(F.count("*").alias("n"), F.count_if(F.col("format") == "xlsx").alias("x"), F.count_if(F.col("format") == "pdf").alias("p"), F.count_if(F.col("format") == "zip").alias("z"))
    c = F.col("company_id")
    companies = nation.join(counted, ["catalogue_id", "company_id"], "left").select(
        "catalogue_id", "company_id", (F.coalesce("n", F.lit(0)) + (c % 13 == 1).cast("long")).alias("artifact_count"), (F.coalesce("x", F.lit(0)) + (c % 17 == 2).cast("long")).alias("workbook_count")
    )
    key = F.col("n_nationkey")
    sums = counted.groupBy("catalogue_id").agg(*(F.sum(x).alias(x) for x in "nxpz")).join(companies.groupBy("catalogue_id").agg(F.count("*").alias("c")), "catalogue_id", "full")
    catalogues = A.table(spark, folder, "nation").select(key, key.alias("catalogue_id")).join(sums, "catalogue_id", "left").fillna(0, list("nxpzc")).select(
        "catalogue_id", F.when(key != 4, W.CATALOGUE_VERSION).alias("schema_version"), (F.col("c") + (key == 5).cast("long")).alias("company_count"), F.when(key != 6, F.col("n")).alias("artifact_count"),
        "x", (F.col("p") + (key == 7).cast("long")).alias("pdf_count"), F.col("z").alias("archive_count"),
    ).withColumnRenamed("x", "workbook_count")
    return catalogues, companies, artifacts


_ARTIFACTS = f"""s AS (SELECT s_suppkey AS company_id, s_nationkey AS catalogue_id FROM supplier),
f AS (SELECT o_orderkey AS k, o_orderkey % (SELECT count(*) FROM supplier) AS company_id, {_list(_FILES)}[o_orderkey % {len(_FILES)} + 1] AS path FROM orders),
a AS (SELECT CASE WHEN k % 997 = 3 THEN -1 ELSE catalogue_id END AS catalogue_id, CASE WHEN k % 211 = 5 THEN 0 ELSE k END AS artifact_id, CASE WHEN k % 223 = 6 THEN -5 ELSE company_id END AS company_id,
  CASE WHEN k % 227 = 7 THEN 'other' ELSE {_CATEGORY} END AS category, k, lower(regexp_extract(path, '[.]([A-Za-z]+)$', 1)) AS format FROM f JOIN s USING (company_id)),
w AS (SELECT catalogue_id, count(*) AS n FROM a GROUP BY 1)"""


@query(f"""WITH {_ARTIFACTS}
SELECT CAST(catalogue_id AS VARCHAR) AS owner, 'duplicate-artifact' AS rule, CAST(artifact_id AS VARCHAR) AS entity FROM a GROUP BY catalogue_id, artifact_id HAVING count(*) > 1
UNION ALL SELECT CAST(a.catalogue_id AS VARCHAR), 'artifact-company', CAST(artifact_id AS VARCHAR) FROM a LEFT JOIN s ON a.company_id = s.company_id AND a.catalogue_id = s.catalogue_id WHERE s.company_id IS NULL
UNION ALL SELECT CAST(catalogue_id AS VARCHAR), 'artifact-category', CAST(artifact_id AS VARCHAR) FROM a WHERE category = 'other'
UNION ALL SELECT CAST(catalogue_id AS VARCHAR), 'artifact-redistribution', CAST(artifact_id AS VARCHAR) FROM a WHERE k % 229 = 8 OR k % 233 = 9
UNION ALL SELECT CAST(catalogue_id AS VARCHAR), 'company-artifact-count', CAST(company_id AS VARCHAR) FROM s WHERE company_id % 13 = 1
UNION ALL SELECT CAST(catalogue_id AS VARCHAR), 'company-workbook-count', CAST(company_id AS VARCHAR) FROM s WHERE company_id % 17 = 2
UNION ALL SELECT '4', 'schema-version', '4' UNION ALL SELECT '5', 'company-count', '5' UNION ALL SELECT '6', 'artifact-count', '6' UNION ALL SELECT '7', 'format-count', '7'""")
def evidence_catalogue_violations(spark, folder):
    return W.evidence_catalogue_violations(*evidence_catalogues(spark, folder))


def scoring_workspaces(spark, folder):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = A.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("workspace_id"), F.when(F.col("c_custkey") % 31 == 1, 2).otherwise(1).alias("version"), F.when(F.col("c_custkey") % 37 != 2, "").alias("default_reviewer"), F.lit("2026-08-01").alias("updated_at")
    )
    indicator = F.concat(F.lit("R"), F.lpad((k % 22 + 1).cast("string"), 2, "0"))
    period = F.date_format("o_orderdate", "yyyy-MM-dd")
    own = A.table(spark, folder, "orders").select(k, c.alias("workspace_id"), indicator.alias("indicator_id"), period.alias("period"))
    ids = F.when(k % 83 == 1, F.array(F.lit("e1"), F.lit("e1"), F.lit("e2"), F.lit("e3"))).when(k % 89 != 2, F.array(*(F.lit(f"e{i}") for i in range(1, 7))))
    text = lambda v: F.lit(v)
    observations = own.select(
        "workspace_id", F.when(k % 101 == 3, "  ").when(k % 103 == 4, "o-twice").otherwise(F.concat(F.lit("o"), k)).alias("observation_id"), F.concat(F.lit("c"), k % 9).alias("company_id"),
        F.when(k % 107 == 5, "R01").otherwise(F.col("indicator_id")).alias("indicator_id"), F.when(k % 107 == 5, "2026").otherwise(F.col("period")).alias("period"), F.when(k % 109 == 6, "odd").when(k % 113 != 7, "partial").alias("status"),
        text("u").alias("unit"), text("v").alias("rule_version"), F.when(k % 127 == 8, "open").when(k % 2 == 0, "reviewed").alias("review_status"), text("").alias("reviewed_by"), text("").alias("reviewed_at"),
        F.when(k % 131 != 9, "").alias("note"), ids.alias("evidence_ids"),
    )
    line = A.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"))
    p, i = F.col("p"), F.col("i")
    bindings = line.join(own, "o_orderkey").select(
        "workspace_id", F.when(p % 139 == 1, "b").otherwise(F.concat(F.lit("b"), k, F.lit("-"), i)).alias("binding_id"), F.when(p % 149 == 2, "gone").otherwise(F.concat(F.lit("o"), k)).alias("observation_id"),
        F.when(p % 151 == 3, "c-other").otherwise(F.concat(F.lit("c"), k % 9)).alias("company_id"), "indicator_id", "period", F.when(p % 157 == 4, "U").otherwise("u").alias("unit"), F.concat(F.lit("e"), i).alias("evidence_id"),
        F.when(p % 163 != 5, "at").alias("locator"), text("").alias("created_at"), text("").alias("updated_at"),
    )
    return w, observations, bindings


_WORKSPACES = """w AS (SELECT c_custkey AS workspace_id FROM customer),
own AS (SELECT o_orderkey AS k, o_custkey AS workspace_id, 'R' || lpad(CAST(o_orderkey % 22 + 1 AS VARCHAR), 2, '0') AS indicator, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
o AS (SELECT k, workspace_id, CASE WHEN k % 101 = 3 THEN '  ' WHEN k % 103 = 4 THEN 'o-twice' ELSE 'o' || k END AS observation_id, 'c' || (k % 9) AS company_id, CASE WHEN k % 107 = 5 THEN 'R01' ELSE indicator END AS indicator_id,
  CASE WHEN k % 107 = 5 THEN '2026' ELSE day END AS period FROM own),
b AS (SELECT workspace_id, p.l_partkey AS p, CASE WHEN p.l_partkey % 139 = 1 THEN 'b' ELSE 'b' || k || '-' || l_linenumber END AS binding_id, CASE WHEN p.l_partkey % 149 = 2 THEN 'gone' ELSE 'o' || k END AS observation_id,
  k, l_linenumber AS i, 'e' || l_linenumber AS evidence_id, indicator, day FROM lineitem p JOIN own ON l_orderkey = k),
bound AS (SELECT b.*, o.observation_id IS NOT NULL AS there, o.indicator_id AS oi, o.period AS op FROM b LEFT JOIN o ON b.workspace_id = o.workspace_id AND b.observation_id = o.observation_id),
v AS (SELECT workspace_id, 'version' AS rule, CAST(workspace_id AS VARCHAR) AS entity FROM w WHERE workspace_id % 31 = 1
UNION ALL SELECT workspace_id, 'text:default_reviewer', CAST(workspace_id AS VARCHAR) FROM w WHERE workspace_id % 37 = 2
UNION ALL SELECT workspace_id, 'observation-id', observation_id FROM o WHERE k % 101 = 3
UNION ALL SELECT workspace_id, 'status', observation_id FROM o WHERE k % 109 = 6 OR k % 113 = 7
UNION ALL SELECT workspace_id, 'review-status', observation_id FROM o WHERE k % 127 = 8
UNION ALL SELECT workspace_id, 'evidence-ids', observation_id FROM o WHERE k % 89 = 2 AND k % 83 <> 1
UNION ALL SELECT workspace_id, 'repeated-evidence', observation_id FROM o WHERE k % 83 = 1
UNION ALL SELECT workspace_id, 'text:note', observation_id FROM o WHERE k % 131 = 9
UNION ALL SELECT workspace_id, 'duplicate-observation', observation_id FROM o GROUP BY workspace_id, observation_id HAVING count(*) > 1
UNION ALL SELECT workspace_id, 'duplicate-observation-key', company_id || '|' || indicator_id || '|' || period FROM o GROUP BY workspace_id, company_id, indicator_id, period HAVING count(*) > 1
UNION ALL SELECT workspace_id, 'duplicate-binding', binding_id FROM b GROUP BY workspace_id, binding_id HAVING count(*) > 1
UNION ALL SELECT workspace_id, 'duplicate-binding-key', observation_id || '|' || evidence_id FROM b GROUP BY workspace_id, observation_id, evidence_id HAVING count(*) > 1
UNION ALL SELECT workspace_id, 'unknown-observation', binding_id FROM bound WHERE NOT there
UNION ALL SELECT workspace_id, 'text:locator', binding_id FROM bound WHERE p % 163 = 5
UNION ALL SELECT workspace_id, 'binding-company_id', binding_id FROM bound WHERE there AND p % 151 = 3
UNION ALL SELECT workspace_id, 'binding-indicator_id', binding_id FROM bound WHERE there AND indicator <> oi
UNION ALL SELECT workspace_id, 'binding-period', binding_id FROM bound WHERE there AND day <> op
UNION ALL SELECT workspace_id, 'binding-unit', binding_id FROM bound WHERE there AND p % 157 = 4
UNION ALL SELECT workspace_id, 'binding-evidence', binding_id FROM bound WHERE there AND CASE WHEN k % 83 = 1 THEN i > 3 WHEN k % 89 = 2 THEN true ELSE i > 6 END)"""


@query(f"WITH {_WORKSPACES} SELECT CAST(workspace_id AS VARCHAR) AS owner, rule, entity FROM v")
def workspace_violations(spark, folder):
    return W.workspace_violations(*scoring_workspaces(spark, folder))


@query(f"""WITH {_WORKSPACES}, n AS (SELECT workspace_id, count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM v GROUP BY 1)
SELECT CAST(workspace_id AS VARCHAR) AS workspace_id, n IS NULL AS usable, coalesce(n, 0) AS violations, coalesce(rules, '') AS rules, CASE WHEN n IS NULL THEN '' ELSE '{W.RESTORED}' END AS warning FROM w LEFT JOIN n USING (workspace_id)""")
def loaded_workspaces(spark, folder):
    tables = scoring_workspaces(spark, folder)
    out = W.loaded_workspaces(tables[0], W.workspace_violations(*tables))
    return out.withColumn("rules", F.array_join("rules", ","))
