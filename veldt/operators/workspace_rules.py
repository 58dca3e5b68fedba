"""Rules of evidence catalogues and of scoring workspaces, any number of them judged together.

Every rule is an expression on a row, one aggregate or one join by the owner's key, so that a large
catalogue or workspace is no task of its own. Violations: owner, rule, entity. A sound owner has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.operators.enrich import CATEGORIES, FORMATS

# Versions, the only redistribution that a catalogue may name, statuses, texts of a reader.
CATALOGUE_VERSION = "KCR-ENTERPRISE-EVIDENCE-2026.08-v1"
WORKSPACE_VERSION = 1
REDISTRIBUTION = "private-metadata-only"
STATUSES = ("available", "partial", "unavailable")
REVIEWS = ("reviewed", "pending")
RESTORED = "检测到损坏或未知版本的评分数据，已备份并恢复初始工作区。"
#: texts that every record must have; they may be empty
OBSERVATION_TEXTS = ("company_id", "indicator_id", "unit", "rule_version", "reviewed_by", "reviewed_at", "period", "note")
BINDING_TEXTS = ("company_id", "indicator_id", "evidence_id", "period", "unit", "locator", "created_at", "updated_at")


def _found(df: DataFrame, owner: str, rule: str | Column, *entity: str) -> DataFrame:
    key = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in entity)) if entity else F.col(owner).cast("string")
    return df.select(F.col(owner).cast("string").alias("owner"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), key.alias("entity"))


def _judged(df: DataFrame, owner: str, rules: dict[str, Column], *entity: str) -> DataFrame:
    """A row for every rule that a record breaks; the table is read once for all of them."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), rule) for rule, bad in rules.items())))
    return _found(df.withColumn("_rule", F.explode(broken)), owner, F.col("_rule"), *entity)


def _repeated(df: DataFrame, owner: str, keys: list[str], rule: str) -> DataFrame:
    return _found(df.groupBy(owner, *keys).agg(F.count("*").alias("_n")).where("_n > 1"), owner, rule, *keys)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def blank(c: Column) -> Column:
    """Whether a text is missing or holds white space only, of any script."""
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x{FEFF}]")


def evidence_catalogue_violations(catalogues: DataFrame, companies: DataFrame, artifacts: DataFrame) -> DataFrame:
    """owner (catalogue_id), rule, entity of everything that is wrong with catalogues of evidence.

    catalogues: catalogue_id, schema_version, company_count, artifact_count, workbook_count, pdf_count, archive_count;
    companies: catalogue_id, company_id, artifact_count, workbook_count; artifacts: catalogue_id, artifact_id,
    company_id, category, format, redistribution. Artifacts are counted once, by company; catalogues add these counts up.
    A null count agrees with none. An identifier that occurs more than once is named once.
    """
    own = "catalogue_id"
    formats = {f: F.count_if(F.col("format") == f) for f in FORMATS}
    per = artifacts.groupBy(own, "company_id").agg(F.count("*").alias("_n"), *(n.alias(f"_{f}") for f, n in formats.items()))
    counts = [f"_{x}" for x in ("n", *FORMATS)]
    whole = per.groupBy(own).agg(*(F.sum(c).alias(c) for c in counts)).join(companies.groupBy(own).agg(F.count("*").alias("_companies")), own, "full")
    stated = catalogues.join(whole, own, "left").fillna(0, [*counts, "_companies"])
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    by_company = companies.join(per, [own, "company_id"], "left").fillna(0, counts)
    unknown = artifacts.join(companies.select(own, "company_id").distinct(), [own, "company_id"], "left_anti")
    return _all(
        _judged(stated, own, {
            "schema-version": ~F.col("schema_version").eqNullSafe(F.lit(CATALOGUE_VERSION)), "company-count": differs("company_count", "_companies"), "artifact-count": differs("artifact_count", "_n"),
            "format-count": differs("workbook_count", "_xlsx") | differs("pdf_count", "_pdf") | differs("archive_count", "_zip"),
        }),
        _repeated(artifacts, own, ["artifact_id"], "duplicate-artifact"),
        _found(unknown, own, "artifact-company", "artifact_id"),
        _judged(artifacts, own, {
            "artifact-category": ~F.coalesce(F.col("category").isin(*(v for _, v in CATEGORIES)), F.lit(False)), "artifact-redistribution": ~F.col("redistribution").eqNullSafe(F.lit(REDISTRIBUTION)),
        }, "artifact_id"),
        _judged(by_company, own, {"company-artifact-count": differs("artifact_count", "_n"), "company-workbook-count": differs("workbook_count", "_xlsx")}, "company_id"),
    )


def workspace_violations(workspaces: DataFrame, observations: DataFrame, bindings: DataFrame) -> DataFrame:
    """owner (workspace_id), rule, entity of everything that keeps a scoring workspace from being loaded.

    workspaces: workspace_id, version, default_reviewer, updated_at; observations: workspace_id, observation_id, company_id,
    indicator_id, status, unit, rule_version, review_status (may be null), reviewed_by, reviewed_at, period, evidence_ids
    (array), note; bindings: workspace_id, binding_id, observation_id, and the columns of BINDING_TEXTS.
    A binding must agree with its observation in company, indicator, period and unit, and name evidence that the
    observation lists. Of several observations with one identifier (a violation itself) bindings are held against the least.
    """
    own, o, b = "workspace_id", observations, bindings
    ids, known = F.col("evidence_ids"), F.coalesce("evidence_ids", F.array().cast("array<string>"))
    absent = lambda names: {f"text:{c}": F.col(c).isNull() for c in names}
    keys = ["company_id", "indicator_id", "period", "unit"]
    target = o.groupBy(own, "observation_id").agg(F.min(F.struct(*keys, "evidence_ids")).alias("_o"))
    bound = b.join(target, [own, "observation_id"], "left")
    there = F.col("_o").isNotNull()
    listed = F.coalesce(F.array_contains(F.col("_o.evidence_ids"), F.col("evidence_id")), F.lit(False))
    return _all(
        _judged(workspaces, own, {"version": ~F.col("version").eqNullSafe(F.lit(WORKSPACE_VERSION)), **absent(("default_reviewer", "updated_at"))}),
        _judged(o, own, {
            "observation-id": blank(F.col("observation_id")), "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "review-status": ~F.col("review_status").isin(*REVIEWS),
            "evidence-ids": ids.isNull() | F.exists(known, lambda x: x.isNull()), "repeated-evidence": F.size(F.array_distinct(known)) < F.size(known), **absent(OBSERVATION_TEXTS),
        }, "observation_id"),
        _repeated(o, own, ["observation_id"], "duplicate-observation"),
        _repeated(o, own, ["company_id", "indicator_id", "period"], "duplicate-observation-key"),
        _repeated(b, own, ["binding_id"], "duplicate-binding"),
        _repeated(b, own, ["observation_id", "evidence_id"], "duplicate-binding-key"),
        _judged(bound, own, {
            "binding-id": blank(F.col("binding_id")), "binding-observation-id": blank(F.col("observation_id")), **absent(BINDING_TEXTS), "unknown-observation": ~there,
            **{f"binding-{c}": there & ~F.col(c).eqNullSafe(F.col(f"_o.{c}")) for c in keys}, "binding-evidence": there & ~listed,
        }, "binding_id"),
    )


def loaded_workspaces(workspaces: DataFrame, violations: DataFrame) -> DataFrame:
    """Every workspace with what becomes of it: usable as it is, else backed up (kept, out of use) and the initial one restored.

    workspace_id, usable, violations (number), rules (distinct, sorted), warning (empty where usable).
    """
    by = violations.groupBy(F.col("owner").alias("workspace_id")).agg(F.count("*").alias("violations"), F.array_sort(F.collect_set("rule")).alias("rules"))
    sound = F.col("violations").isNull()
    return workspaces.select(F.col("workspace_id").cast("string")).join(by, "workspace_id", "left").select(
        "workspace_id", sound.alias("usable"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), F.when(sound, "").otherwise(RESTORED).alias("warning")
    )
