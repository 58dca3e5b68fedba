"""Query of the rules of an industry dataset, on mistakes that are planted in tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import industry_rules as I
from veldt.plans import catalogue as C
from veldt.registry import query
from veldt.sources import adapter as A

_KINDS = [(i, "narrative" if d == "narrative" else "weighted") for i, d, _, _ in C.CATALOGUE]
#: indicators as they stand in the planted dataset: one is absent, one twice, one unknown, one of the wrong kind
_GIVEN = [(i, "narrative" if i == "R05" else k) for i, k in _KINDS if i != "R22"] + [("R07", "weighted"), ("R99", "weighted")]
_SOURCES = [(f"src-{i}",) for i, _ in _KINDS] + [("src-R03",)]


def dataset(spark, folder) -> dict:
    s, key = A.table(spark, folder, "supplier"), F.col("s_suppkey")
    companies = s.select(key.cast("string").alias("company_id"), F.when(key % 40 == 3, "/home/me/x").otherwise(F.col("s_name")).alias("name"), F.when(key % 40 == 2, "nowhere").when(key % 40 != 5, F.concat(F.lit("g"), "s_nationkey")).alias("peer_group_id"))
    companies = companies.unionByName(companies.where("company_id % 40 = 1"))
    o, n = A.table(spark, folder, "orders"), F.col("o_orderkey")
    indicator = F.concat(F.lit("R"), F.lpad((n % 21 + 1).cast("string"), 2, "0"))
    observations = o.select(
        n.alias("observation_id"), (F.col("o_custkey") % 107 + 1).cast("string").alias("company_id"), F.when(n % 97 == 0, "R50").otherwise(indicator).alias("indicator_id"), F.concat(F.lit("m"), n % 1000).alias("metric_name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_of_date"), F.when(n % 11 != 0, 1.5).alias("numeric_value"), F.when(n % 33 == 0, "text").alias("text_value"), F.when(n % 22 == 0, " ").otherwise("known").alias("status"),
        ((n % 101) / 95.0).alias("confidence"), F.when(n % 89 == 0, "src-none").otherwise(F.concat(F.lit("src-"), indicator)).alias("source_id"), F.when(n % 83 == 0, F.array(F.lit("src-R01"), F.lit("src-lost"))).alias("source_ids"),
    )
    names = spark.createDataFrame(_GIVEN, "indicator_id string, kind string")
    pairs = s.select(key.cast("string").alias("company_id"), key).join(F.broadcast(names.select("indicator_id").distinct()), F.lit(True)).where((key % 30 != 4) | (F.col("indicator_id") != "R09")).drop("s_suppkey")
    groups = A.table(spark, folder, "nation").select(F.concat(F.lit("g"), "n_nationkey").alias("group_id"), F.when(F.col("n_nationkey") == 7, F.array(F.lit("1"), F.lit("c-lost"))).otherwise(F.array(F.lit("1"))).alias("company_ids"))
    e, i = A.table(spark, folder, "events"), F.col("event_id")
    supplements = e.where("event_type = 'purchase'").select(i.alias("supplement_id"), (F.col("user_id") % 104 + 1).cast("string").alias("company_id"), F.when(i % 71 == 0, "src-none").when(i % 2 == 0, "src-R10").alias("source_id"))
    events = e.where("event_type = 'error'").select(i.alias("event_id"), (F.col("user_id") % 103 + 1).cast("string").alias("company_id"))
    meta = s.agg(F.count("*").alias("sample_size")).select("sample_size", F.lit(22).cast("long").alias("indicator_count"), F.lit("industry-risk-v0").alias("schema_version"))
    return {"meta": meta, "companies": companies, "indicators": names, "observations": observations, "coverage": pairs, "sources": spark.createDataFrame(_SOURCES, "source_id string"), "groups": groups.unionByName(groups.where("group_id = 'g3'")), "supplements": supplements, "events": events}


@query(f"""WITH c0 AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS company_id, CASE WHEN s_suppkey % 40 = 3 THEN '/home/me/x' ELSE s_name END AS name, CASE WHEN s_suppkey % 40 = 2 THEN 'nowhere' WHEN s_suppkey % 40 <> 5 THEN 'g' || s_nationkey END AS peer_group_id FROM supplier),
c AS (SELECT * FROM c0 UNION ALL SELECT * FROM c0 WHERE k % 40 = 1), ids AS (SELECT DISTINCT company_id FROM c),
ind(indicator_id, kind) AS (VALUES {C.as_values(_GIVEN)}), known AS (SELECT DISTINCT indicator_id FROM ind), src(source_id) AS (VALUES {C.as_values(_SOURCES)}),
o0 AS (SELECT o_orderkey AS n, o_custkey, o_orderdate, 'R' || lpad(CAST(o_orderkey % 21 + 1 AS VARCHAR), 2, '0') AS i FROM orders),
o AS (SELECT n, CAST(n AS VARCHAR) AS id, CAST(o_custkey % 107 + 1 AS VARCHAR) AS company_id, CASE WHEN n % 97 = 0 THEN 'R50' ELSE i END AS indicator_id, 'm' || (n % 1000) AS metric_name, strftime(o_orderdate, '%Y-%m-%d') AS as_of_date,
  CASE WHEN n % 89 = 0 THEN 'src-none' ELSE 'src-' || i END AS source_id FROM o0),
e AS (SELECT event_id, user_id, event_type FROM events), d AS (SELECT k, indicator_id FROM c0 CROSS JOIN known WHERE k % 30 <> 4 OR indicator_id <> 'R09')
SELECT 'duplicate-company' AS rule, company_id AS entity FROM c GROUP BY company_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate-indicator', indicator_id FROM ind GROUP BY indicator_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate-observation-key', company_id || '|' || indicator_id || '|' || metric_name || '|' || as_of_date FROM o GROUP BY company_id, indicator_id, metric_name, as_of_date HAVING count(*) > 1
UNION ALL SELECT 'unknown-indicator-id', indicator_id FROM ind WHERE indicator_id = 'R99'
UNION ALL SELECT 'wrong-kind', 'R05'
UNION ALL SELECT 'observation-company', id FROM o WHERE company_id NOT IN (SELECT company_id FROM ids)
UNION ALL SELECT 'observation-indicator', id FROM o WHERE indicator_id NOT IN (SELECT indicator_id FROM known)
UNION ALL SELECT 'observation-source', id FROM o WHERE source_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'observation-without-value', id FROM o WHERE n % 11 = 0 AND n % 33 <> 0 AND n % 22 = 0
UNION ALL SELECT 'observation-confidence', id FROM o WHERE n % 101 > 95
UNION ALL SELECT 'coverage-absent', company_id || '|R09' FROM c0 WHERE k % 30 = 4
UNION ALL SELECT 'schema-version', 'industry-risk-v0'
UNION ALL SELECT 'sample-size', (SELECT count(*) FROM supplier) || '|' || count(*) FROM c HAVING count(*) <> (SELECT count(*) FROM supplier)
UNION ALL SELECT 'indicator-count', '22|' || count(*) FROM ind
UNION ALL SELECT 'duplicate-source', 'src-R03'
UNION ALL SELECT 'missing-indicator', 'R22'
UNION ALL SELECT 'observation-linked-source', id FROM o WHERE n % 83 = 0
UNION ALL SELECT 'duplicate-group', 'g3'
UNION ALL SELECT 'company-group', company_id FROM c WHERE peer_group_id = 'nowhere'
UNION ALL SELECT 'group-member', 'g7'
UNION ALL SELECT 'supplement-company', CAST(event_id AS VARCHAR) FROM e WHERE event_type = 'purchase' AND CAST(user_id % 104 + 1 AS VARCHAR) NOT IN (SELECT company_id FROM ids)
UNION ALL SELECT 'supplement-source', CAST(event_id AS VARCHAR) FROM e WHERE event_type = 'purchase' AND event_id % 71 = 0
UNION ALL SELECT 'event-company', CAST(event_id AS VARCHAR) FROM e WHERE event_type = 'error' AND CAST(user_id % 103 + 1 AS VARCHAR) NOT IN (SELECT company_id FROM ids)
UNION ALL SELECT 'local-path', 'company|' || company_id FROM c WHERE name = '/home/me/x'""")
def dataset_violations(spark, folder):
    d = dataset(spark, folder)
    found = I.dataset_violations(d["meta"], d["companies"], d["indicators"], d["observations"], d["coverage"], d["sources"], d["groups"], d["supplements"], d["events"])
    return found.select("rule", F.col("entity").cast("string").alias("entity"))
