"""Queries of company bundles and of tables with versions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veldt.operators import bundle as K
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.plans.risk_queries import FIXED, LEVEL, coverage, fixed_weight_score
from veldt.plans.scoring_queries import observed
from veldt.registry import query
from veldt.sources import adapter as A
from veldt.sources.snapshots import VersionedTable, shared_folder

_SOURCES = [(f"src-{i}", f"Source of {i}") for i, _, _, _ in C.CATALOGUE]


def bundle_of(spark, folder):
    """One row a supplier: assessment, and observations, coverage, events, supplements and the sources that these name."""
    cited = observed(spark, folder).select(
        "company_id", "observation_id", "indicator_id", "metric_name", "as_of_date", F.concat(F.lit("src-"), "indicator_id").alias("source_id"),
        F.when(F.col("indicator_id") == "R05", F.array(F.lit("src-R06"), F.lit("src-R07"))).alias("source_ids"),
    )
    events = A.events(spark, folder)
    supplement = events.where("kind = 'deep-search'").select("company_id", F.col("event_id").alias("supplement_id"), F.when(F.col("event_id") % 2 == 0, F.lit("src-R22")).alias("source_id"))
    sources = spark.createDataFrame(_SOURCES, "source_id string, title string")
    head = A.companies(spark, folder).select("company_id", "short_name", "peer_group_id").join(fixed_weight_score(spark, folder).select("company_id", "baseline_score", "risk_level"), "company_id", "left")
    return K.bundle(head, {
        "observations": (cited, ["indicator_id", "metric_name", "as_of_date"]),
        "coverage": (coverage(spark, folder).select("company_id", "kind", "status"), ["kind"]),
        "events": (events.drop("value"), ["event_date", "event_id"]),
        "supplements": (supplement, ["supplement_id"]),
        "sources": (K.used_sources([(cited, "source_id", "source_ids"), (supplement, "source_id", None)], sources), ["source_id"]),
    })


_BUNDLE = f"""WITH {O.OBSERVATIONS}{FIXED.removeprefix(O.COMPANIES)},
seen AS (SELECT company_id, kind, count(*) AS n FROM risk_events GROUP BY 1, 2), kinds AS (SELECT DISTINCT kind FROM risk_events),
c1 AS (SELECT company_id, string_agg(indicator_id || ':' || metric_name || ':' || as_of_date, '|' ORDER BY indicator_id, metric_name, as_of_date) AS observations FROM observations GROUP BY 1),
c2 AS (SELECT c.company_id, string_agg(k.kind || ':' || CASE WHEN n IS NULL THEN 'NA-none' ELSE 'available' END, '|' ORDER BY k.kind) AS coverage FROM companies c CROSS JOIN kinds k LEFT JOIN seen s ON s.company_id = c.company_id AND s.kind = k.kind GROUP BY 1),
c3 AS (SELECT company_id, string_agg(event_date || ':' || event_id || ':' || kind, '|' ORDER BY event_date, event_id) AS events FROM risk_events GROUP BY 1),
c4 AS (SELECT company_id, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS supplements FROM risk_events WHERE kind = 'deep-search' GROUP BY 1),
named AS (SELECT company_id, 'src-' || indicator_id AS s FROM observations UNION SELECT company_id, unnest(['src-R06', 'src-R07']) FROM observations WHERE indicator_id = 'R05'
  UNION SELECT company_id, 'src-R22' FROM risk_events WHERE kind = 'deep-search' AND event_id % 2 = 0),
c5 AS (SELECT company_id, string_agg(s || ':Source of ' || substr(s, 5), '|' ORDER BY s) AS sources FROM named GROUP BY 1)
SELECT companies.company_id, short_name, peer_group_id, baseline_score, {LEVEL("baseline_score")} AS risk_level, coalesce(observations, '') AS observations, coalesce(coverage, '') AS coverage,
  coalesce(events, '') AS events, coalesce(supplements, '') AS supplements, coalesce(sources, '') AS sources
FROM companies LEFT JOIN base USING (company_id) LEFT JOIN c1 USING (company_id) LEFT JOIN c2 USING (company_id) LEFT JOIN c3 USING (company_id) LEFT JOIN c4 USING (company_id) LEFT JOIN c5 USING (company_id)"""


@query(_BUNDLE)
def company_bundle(spark, folder):
    b = bundle_of(spark, folder)
    return b.select(
        "company_id", "short_name", "peer_group_id", "baseline_score", "risk_level", K.listed("observations", "indicator_id", "metric_name", "as_of_date").alias("observations"), K.listed("coverage", "kind", "status").alias("coverage"),
        K.listed("events", "event_date", "event_id", "kind").alias("events"), K.listed("supplements", "supplement_id").alias("supplements"), K.listed("sources", "source_id", "title").alias("sources"),
    )


@query("""WITH s AS (SELECT s_suppkey, s_name, s_acctbal, s_suppkey % 5 AS k FROM supplier)
SELECT s_suppkey AS company_id, CASE WHEN k = 1 THEN 'watched' WHEN k = 2 THEN 'closed' ELSE 'open' END AS status, CASE WHEN k = 1 THEN 'note ' || s_suppkey WHEN k IN (2, 3) THEN s_name END AS note, CASE WHEN k = 3 THEN 2 ELSE 1 END AS created_in
FROM s WHERE k <> 4""")
def versioned_state(spark, folder):
    """State of suppliers after a first version, an upsert that keeps the time of creation, a patch, a deletion and a migration."""
    key = F.col("s_suppkey")
    s = A.table(spark, folder, "supplier").select(key.alias("company_id"), (key % 5).alias("k"), "s_name")
    at = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    old = VersionedTable(spark, at, "company_id long, state string, note string, created_in int")
    old.commit(s.where("k <> 3").select("company_id", F.lit("open").alias("state"), F.lit(None).cast("string").alias("note"), F.lit(1).alias("created_in")), 0)
    table = VersionedTable(spark, at, "company_id long, status string, note string, created_in int", 2, {1: lambda d: d.withColumnRenamed("state", "status")})
    changed = s.where("k IN (2, 3)").select("company_id", F.when(F.col("k") == 2, "closed").otherwise("open").alias("status"), F.col("s_name").alias("note"), F.lit(2).alias("created_in"))
    table.upsert(changed, ["company_id"], ["created_in"])
    table.patch(s.where("k = 1").select("company_id", F.lit("watched").alias("status"), F.concat(F.lit("note "), "company_id").alias("note")), ["company_id"])
    table.delete(F.col("company_id") % 5 == 4)
    return table.read().select("company_id", "status", "note", "created_in")
