"""Event normalisation, views and corrections against values that the published rules give."""

import pytest
from pyspark.sql import functions as F

from veldt.functions import numeric, text
from veldt.operators import enrich as N
from veldt.operators import events as E
from veldt.operators import merge as M
from veldt.operators import technology as T
from veldt.operators import views as V


def test_heat_colours_of_the_published_scale(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (50.0,), (75.0,), (100.0,), (140.0,), (None,)], "s double")
    got = [r.c for r in df.select(numeric.heat_colour(F.col("s")).alias("c")).collect()]
    assert got == ["#22d3ee", "#8ed082", "#facc15", "#f5882d", "#ef4444", "#ef4444", "#64748b"]


def test_periods(spark):
    cases = {"2025-03-07": 20250307, "2025年3月7日": 20250307, "2026-q2": 20260631, "2024年第四季度": 20241231, "2025 H1": 20250631, "2025年下半年": 20251231, "2025年1-6月": 20250631, "2024/2": 20240231, "2024年业绩": 20241231, " 2024 ": 20241231, "on 2025-03-07": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.k for r in df.select("p", text.period_key(F.col("p")).alias("k")).collect()} == cases


def test_catalogue_refuses_other_formats(spark):
    df = spark.createDataFrame([("a/全部.ZIP",), ("2024年报.pdf",)], "path string")
    assert sorted((r.category, r["class"], r.format) for r in N.catalogued(df).collect()) == [("annual-reporting", "public-filing", "pdf"), ("archive", "private-archive", "zip")]
    with pytest.raises(Exception, match="unknown file type"):
        N.catalogued(spark.createDataFrame([("a.docx",)], "path string")).collect()


def test_patches_by_presence_and_ties_of_versions(spark):
    state = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id int, p string, q string")
    patch = spark.createDataFrame([(1, None, "n", ["p"]), (2, "B", None, ["p", "q"])], "id int, p string, q string, given array<string>")
    assert sorted(tuple(r) for r in M.patched(state, patch, ["id"]).collect()) == [(1, None, "x"), (2, "B", None), (3, "c", "z")]
    changes = spark.createDataFrame([(1, "k", "m", 5), (1, "j", "n", 5), (4, "new", None, 1)], "id int, p string, q string, version long")
    assert sorted(tuple(r)[:3] for r in M.upserted(state, changes, ["id"]).select("id", "p", "q").collect()) == [(1, "k", "m"), (2, "b", "y"), (3, "c", "z"), (4, "new", None)]
    tasks = spark.createDataFrame([("t1", "open", "d0"), ("t2", "open", "d0")], "task_id string, status string, updated_at string")
    assert sorted(tuple(r) for r in M.status_set(tasks, ["t2"], "done", "d1").collect()) == [("t1", "open", "d0"), ("t2", "done", "d1")]
    assert [r.id for r in M.cleared(state, spark.createDataFrame([(1,), (3,)], "id int"), "id").collect()] == [2]


def test_forced_reasons_raise_a_score(spark):
    flags = spark.createDataFrame([("a", False, None, True, False, True, False, True), ("b", False, False, False, False, False, False, None)], "company_id string, patent_failure boolean, stale boolean, self_assessed boolean, safety_failure boolean, single_source boolean, export_restriction boolean, license_risk boolean")
    reasons = T.forced_reasons(flags)
    assert {r.company_id: r.reasons for r in reasons.collect()} == {"a": ["TRL 仅为自评且缺少实验或示范证据", "关键技术外部依赖红旗：不可替代高影响单一来源、关键许可证不可续期"], "b": []}
    base = spark.createDataFrame([("a", 100, 30.0), ("b", 100, 30.0), ("c", 50, None)], "company_id string, coverage long, base_score double")
    overlay = spark.createDataFrame([("b", "i", 1.5, 40, False)], "company_id string, incident_id string, incident_index double, floor int, forced boolean")
    assert {r.company_id: r.score for r in T.final_score(base, overlay, reasons).collect()} == {"a": 85.0, "b": 40.0, "c": None}


def test_lens_falls_back_to_all_without_scores(spark):
    some = spark.createDataFrame([("a", 70.0), ("b", 59.0), ("c", None)], "company_id string, score double")
    assert [r.company_id for r in V.risk_lens(some, 60).collect()] == ["a"]
    none = some.withColumn("score", F.lit(None).cast("double"))
    assert [r.company_id for r in V.risk_lens(none, 60).collect()] == ["a", "b", "c"]


def test_best_overlap_takes_the_first_of_equals(spark):
    events = spark.createDataFrame([(1, "c", ["x", "y"]), (2, "c", ["q"]), (3, "d", ["x"])], "event_id int, company_id string, evidence_ids array<string>")
    nodes = spark.createDataFrame([("n1", "c", 0, ["z"]), ("n2", "c", 1, ["x", "y"]), ("n3", "c", 2, ["y", "x"])], "node_id string, company_id string, position int, evidence_ids array<string>")
    got = {r.event_id: (r.node_id, r.shared) for r in E.overlapping(events, nodes).collect()}
    assert got == {1: ("n2", 2), 2: ("n1", 0), 3: ("n2", 1)}


def test_privacy_penalties_and_person_risks(spark):
    p = spark.createDataFrame([("a", "数据安全 违规"), ("a", "环保"), ("b", "网信办")], "company_id string, reason string")
    assert {r.company_id: (r.privacy_penalties, r.penalties) for r in N.privacy_penalties(p).collect()} == {"a": (1, 2), "b": (1, 1)}
    q = spark.createDataFrame([("a", 1, None), ("a", 2, 3)], "company_id string, x int, y int")
    assert N.person_risks(q, ["x", "y"]).first().person_risks == 6
