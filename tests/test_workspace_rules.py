"""Rules of evidence catalogues and scoring workspaces on small tables, each broken once."""

from veldt.operators import workspace_rules as W

ARTIFACT = "catalogue_id string, artifact_id string, company_id string, category string, format string, redistribution string, rule string"
OBSERVATION = (
    "workspace_id string, observation_id string, company_id string, indicator_id string, status string, unit string, rule_version string, review_status string, "
    "reviewed_by string, reviewed_at string, period string, evidence_ids array<string>, note string"
)
BINDING = (
    "workspace_id string, binding_id string, observation_id string, company_id string, indicator_id string, evidence_id string, period string, unit string, locator string, created_at string, updated_at string"
)


def found(df):
    return sorted(tuple(r) for r in df.select("owner", "rule", "entity").collect())


def catalogue(spark, artifacts, company=(2, 1), stated=(1, 2, 1, 1, 0), version=W.CATALOGUE_VERSION):
    a = spark.createDataFrame([(*r, "a column of the caller") for r in artifacts], ARTIFACT)
    c = spark.createDataFrame([("k", "c1", *company)], "catalogue_id string, company_id string, artifact_count long, workbook_count long")
    s = spark.createDataFrame([("k", version, *stated), ("empty", W.CATALOGUE_VERSION, 0, 0, 0, 0, 0)], "catalogue_id string, schema_version string, company_count long, artifact_count long, workbook_count long, pdf_count long, archive_count long")
    return found(W.evidence_catalogue_violations(s, c, a))


def test_catalogues(spark):
    good = [("k", "a1", "c1", "litigation", "xlsx", W.REDISTRIBUTION), ("k", "a2", "c1", "archive", "pdf", W.REDISTRIBUTION)]
    assert catalogue(spark, good) == []
    assert catalogue(spark, [good[0], ("k", "a1", "c9", None, "pdf", None)], company=(1, 1)) == [
        ("k", "artifact-category", "a1"), ("k", "artifact-company", "a1"), ("k", "artifact-redistribution", "a1"), ("k", "duplicate-artifact", "a1"),
    ]
    assert catalogue(spark, good, company=(3, None), stated=(2, None, 1, 2, 0), version="old") == [
        ("k", "artifact-count", "k"), ("k", "company-artifact-count", "c1"), ("k", "company-count", "k"), ("k", "company-workbook-count", "c1"), ("k", "format-count", "k"), ("k", "schema-version", "k"),
    ]
    assert catalogue(spark, [], company=(0, 0), stated=(1, 0, 0, 0, 0)) == []
    # an artifact without a company belongs to none, in whatever catalogue
    assert catalogue(spark, [*good, ("k", "a3", None, "archive", "zip", W.REDISTRIBUTION)], stated=(1, 3, 1, 1, 1)) == [("k", "artifact-company", "a3")]


def test_workspaces(spark):
    o = dict(workspace_id="w", observation_id="o", company_id="c", indicator_id="R01", status="partial", unit="", rule_version="1", review_status=None, reviewed_by="", reviewed_at="", period="2026", evidence_ids=["e", "f"], note="")
    b = dict(workspace_id="w", binding_id="b", observation_id="o", company_id="c", indicator_id="R01", evidence_id="e", period="2026", unit="", locator="", created_at="", updated_at="")
    w = spark.createDataFrame([("w", 1, "", "now")], "workspace_id string, version int, default_reviewer string, updated_at string")

    def of(observations, bindings, workspaces=w):
        rows = lambda xs, schema: spark.createDataFrame([tuple(x.values()) for x in xs], schema)
        return [(rule, entity) for _, rule, entity in found(W.workspace_violations(workspaces, rows(observations, OBSERVATION), rows(bindings, BINDING)))]

    assert of([o], [b, {**b, "binding_id": "b2", "evidence_id": "f"}]) == [] and of([], []) == []
    assert of([{**o, "observation_id": " ﻿"}], []) == [("observation-id", " ﻿")]
    assert of([{**o, "status": None, "review_status": "odd", "evidence_ids": ["e", None, "e"], "note": None}], []) == [("evidence-ids", "o"), ("repeated-evidence", "o"), ("review-status", "o"), ("status", "o"), ("text:note", "o")]
    assert of([{**o, "evidence_ids": None}], [b]) == [("binding-evidence", "b"), ("evidence-ids", "o")]
    assert of([o, {**o, "period": "2025"}, {**o, "observation_id": "o2"}], []) == [("duplicate-observation", "o"), ("duplicate-observation-key", "c|R01|2026")]
    assert of([o], [b, b, {**b, "binding_id": "b3", "observation_id": "none"}]) == [("duplicate-binding", "b"), ("duplicate-binding-key", "o|e"), ("unknown-observation", "b3")]
    assert of([o], [{**b, "company_id": "C", "indicator_id": "R02", "period": "2025", "unit": "x", "evidence_id": "g", "locator": None}]) == [
        ("binding-company_id", "b"), ("binding-evidence", "b"), ("binding-indicator_id", "b"), ("binding-period", "b"), ("binding-unit", "b"), ("text:locator", "b"),
    ]
    old = spark.createDataFrame([("w", 2, None, "now"), ("v", 1, "", "now")], w.schema)
    assert of([o], [b], old) == [("text:default_reviewer", "w"), ("version", "w")]
    # observations of another workspace are none of this one's
    assert of([o], [{**b, "workspace_id": "v"}], old)[-1] == ("version", "w") and ("unknown-observation", "b") in of([o], [{**b, "workspace_id": "v"}], old)
    every = W.workspace_violations(old, spark.createDataFrame([tuple(o.values())], OBSERVATION), spark.createDataFrame([], BINDING))
    loaded = {r.workspace_id: (r.usable, r.violations, r.rules, r.warning) for r in W.loaded_workspaces(old, every).collect()}
    assert loaded == {"v": (True, 0, [], ""), "w": (False, 2, ["text:default_reviewer", "version"], W.RESTORED)}
