"""References of a report: every one resolves, is numbered once, and stands in the order of its first mention."""

from veldt.operators import export as X


def frames(spark, dims, events, bindings, evidence):
    return (
        spark.createDataFrame(dims, "company_id string, label string, place int, score double, score_basis string, evidence_ids array<string>, indicator_ids array<string>"),
        spark.createDataFrame(events, "company_id string, event_id string, place int, evidence_ids array<string>, source_url string, source_name string, source_type string, risk_type string, source_published_at string, identified_at string"),
        spark.createDataFrame(bindings, "company_id string, evidence_id string, indicator_id string, period string, locator string, place int"),
        spark.createDataFrame(evidence, "company_id string, evidence_id string, source_name string, title string, published_at string, source_url string, support string"),
    )


def test_order_roles_and_addresses(spark):
    dims = [("c", "Tech", 0, 50.0, X.AUTOMATIC, ["e2", "e1", "e2"], ["T01"]), ("c", "Law", 1, None, X.AUTOMATIC, ["e3"], ["C01"]), ("d", "Tech", 0, 1.0, None, [], [])]
    events = [
        ("c", "v1", 0, ["e3", "e4"], "u9", None, "web", "fire", None, "2024-02-02"), ("c", "v2", 1, ["e1"], "u1", "press", "web", "theft", "2024-01-01", "2024-02-02"),
        ("c", "v3", 2, [], "u9", "press", "web", "flood", None, "2024-03-03"), ("c", "v4", 3, ["e5"], None, None, "web", "x", None, "2024-03-03"),
    ]
    bindings = [("c", "e5", " C02 ", "2024", "p. 1", 0), ("c", "e5", "C02", " 2024", "p. 1", 1), ("c", "e3", "C01", "2023", "p. 2", 2), ("c", "e6", "C03", " ", "p. 3", 3)]
    evidence = [("c", "e1", "S", "one", "2020", "u1", "direct"), ("c", "e3", "S", "three", None, None, "pending"), ("c", "e5", "S", "five", None, "u5", None), ("d", "e2", "other", "other", None, None, None)]
    got = [r for r in X.references(*frames(spark, dims, events, bindings, evidence)).orderBy("company_id", "number").collect()]
    assert [(r.reference_id, r.evidence_id) for r in got] == [(f"SRC-00{i}", e) for i, e in enumerate(["e2", "e1", "e3", "e4", "e5", "e6", ""], 1)]
    assert [r.role for r in got] == [X.SCORED, X.BOTH, X.BOTH, X.EVENT, X.BOTH_UNSCORED, X.EVENT, X.EVENT]
    by = {r.evidence_id: r for r in got}
    assert by["e2"].title == X.NO_TITLE and by["e2"].indicator_ids == ["T01"] and by["e1"].source_url == "u1" and by["e1"].support == "直接披露"
    assert by["e3"].indicator_ids == ["C01"] and by["e3"].dimension_labels == ["Law"] and by["e3"].event_ids == ["v1"] and by["e3"].eligible == X.YES
    assert by["e5"].indicator_ids == ["C02"] and by["e5"].periods == ["2024"] and by["e5"].eligible == X.NO and by["e5"].support == X.PENDING
    # v2's address is its evidence's own; v1 and v3 share one, and the first tells its words
    assert (by[""].source_url, by[""].event_ids, by[""].source_name, by[""].title, by[""].published_at) == ("u9", ["v1", "v3"], "web", "fire" + X.DIRECT_TITLE, "2024-02-02")


def test_empty_tables_have_no_references(spark):
    parts = frames(spark, [], [], [], [])
    assert X.references(*parts).count() == 0
