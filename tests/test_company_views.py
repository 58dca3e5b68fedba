"""Views of companies on small tables: ties, companies without rows, texts."""

from pyspark.sql import functions as F

from veldt.operators import company_views as V
from veldt.sources.snapshots import written


def test_overview_summaries_and_trend(spark):
    company = spark.createDataFrame([("a", "A"), ("b", "B")], "company_id string, short_name string")
    events = spark.createDataFrame(
        [("a", 5, "inquiry", "x", "late", "R11", "2024-03-30", "medium"), ("a", 9, "deep-search", "y", "first", "R09", "2024-03-30", "high"), ("a", 2, "deep-search", "z", "old", "R09", "2023-11-01", "high"), ("a", 10, "deep-search", "w", "twin", "R09", "2024-03-30", "high")],
        "company_id string, event_id long, kind string, event_type string, title string, indicator_id string, event_date string, severity string",
    )
    over = V.event_overview(events)
    assert [tuple(r) for r in over.collect()] == [("a", 3, 1, 4, 9, "y", "R09", "first")]
    dims = spark.createDataFrame([("a", "external", 50.0), ("a", "technology", 50.0), ("a", "finance", 10.0), ("a", "narrative", None)], "company_id string, dimension_id string, dimension_score double")
    totals = spark.createDataFrame([("a", 41.5)], "company_id string, total_score double")
    peers = spark.createDataFrame([("a", "b")], "company_id string, next_company_id string")
    named = spark.createDataFrame([("a", "s1"), ("a", "s2")], "company_id string, source_id string")
    got = {r.company_id: tuple(r)[1:] for r in V.company_summaries(company, totals, dims, over, named, peers).collect()}
    labels = V.LABELS
    assert got["a"] == ("A", 41.5, [labels["technology"], labels["external"]], 6, 3, 1, "b", "first")
    assert got["b"] == ("B", None, [], 0, 0, 0, "b", V.NO_HIGH_EVENT)
    # the 31st of March less one month runs over into March: that month stands twice, as a reader of the views knows it
    trend = sorted(tuple(r) for r in V.company_trend(company.where("company_id = 'a'"), events, "2024-03-31").collect())
    assert [t[1] for t in trend] == ["2023-10", "2023-12", "2023-12", "2024-01", "2024-03", "2024-03"] and trend[-1] == ("a", "2024-03", 2, 1, 3)


def test_dimensions_round_half_up_and_name_their_indicators(spark):
    company = spark.createDataFrame([("a",), ("b",)], "company_id string")
    scores = spark.createDataFrame([("a", "finance", "R14", 60.5), ("a", "finance", "R13", 58.5), ("a", "external", "R17", None), ("a", "technology", "R05", 74.5)], "company_id string, dimension_id string, indicator_id string, risk_score double")
    got = {(r.company_id, r.dimension_id): (r.score, r.level, r.weight, r.indicator_ids) for r in V.company_dimensions(company, scores).collect()}
    assert len(got) == 12 and got["a", "finance"] == (60, "medium-high", "4/22", ["R13", "R14"])
    assert got["a", "technology"] == (75, "high", "5/22", ["R05"]) and got["a", "external"] == (0, "low", "3/22", []) == got["b", "external"]


def test_observations_sources_and_values(spark):
    o = spark.createDataFrame(
        [("a", "R05", "o2", "m", "2024", 1234567.00005, "%", None, "s", 0.5, "s1", ["s1", "s2"]), ("a", "R05", "o1", "n", "2024", 0.0, None, None, "s", 0.9, "s1", None), ("a", "R05", "o0", "old", None, 1.0, "", "t", "s", None, None, None), ("a", "R13", "o3", "k", "2023", None, "x", "", "none", 0.1, "gone", ["s2"])],
        "company_id string, indicator_id string, observation_id string, metric_name string, as_of_date string, numeric_value double, unit string, text_value string, status string, confidence double, source_id string, source_ids array<string>",
    )
    latest = V.latest_by_indicator(o)
    assert sorted((r.place, r.indicator_id, r.metric_name, r.value) for r in V.disclosures(latest).collect()) == [(1, "R05", "n", "0"), (2, "R13", "k", "none")]
    shown = o.select(V.shown_value(*(F.col(c) for c in ("numeric_value", "unit", "text_value", "status"))).alias("v")).collect()
    assert [r.v for r in shown] == ["1,234,567.0001 %", "0", "1", "none"]
    sources = spark.createDataFrame([("s1", "年报", "公司", "licensed-derived"), ("s2", None, "上交所", None), ("s3", "", "", "manual"), ("s4", "", "", "")], "source_id string, source_type string, institution string, redistribution string")
    more = spark.createDataFrame([("a", "s3"), ("a", None)], "company_id string, source_id string")
    got = {r.source_id: (r.reliability, r.indicator_ids, r.dimensions, r.confidence, r.strength, r.observations, r.links) for r in V.source_evidence(o, more, sources).collect()}
    assert got["s1"] == ("filing", ["R05"], [V.LABELS["technology"]], 0.9, "background", 2, ["R05:2024:n", "R05:2024:%:m"])
    assert got["s2"][:6] == ("exchange", ["R05", "R13"], [V.LABELS["technology"], V.LABELS["finance"]], 0.75, "direct", 2)
    assert got["s3"] == ("media", [], [V.NARRATIVE], 0.75, "direct", 0, []) and len(got) == 3
    coverage = spark.createDataFrame([("a", "R05", "NA-x", False)], "company_id string, indicator_id string, status string, usable boolean")
    rows = sorted(tuple(r) for r in V.indicator_observations(latest, coverage, sources).collect())
    assert rows == [("a", "R05", "o1", "unavailable", "pending", "2024", "r01-evidence:s1"), ("a", "R13", "o3", "unavailable", "pending", "2023", None)]


def test_a_written_table_is_read_from_a_scan(spark):
    df = written(spark.range(5).withColumn("m", F.col("id") % 2).groupBy("m").agg(F.count("*").alias("n")), "t")
    assert sorted(tuple(r) for r in df.collect()) == [(0, 3), (1, 2)]
    assert "Aggregate" not in df._jdf.queryExecution().analyzed().toString()
