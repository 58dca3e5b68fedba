import pytest
from pyspark.sql import functions as F

from veldt.functions import dates as D
from veldt.functions.text import number_text
from veldt.operators import taxonomy as X


def values(spark, column, rows, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_dates_as_they_are_shown(spark):
    c, rows = F.col("c"), ["2024-07-05", "2024-07-05T18:30:00Z", "2024-02-30", "2024-02-32", "2024-13-01", "soon", None, "2024-07", "2024"]
    assert values(spark, D.is_date(c), rows) == [True, True, True, False, False, False, False, True, True]
    assert values(spark, D.shown_date(c), rows) == ["2024年7月5日", "2024年7月6日", "2024年3月1日", "2024-02-32", "2024-13-01", "soon", None, "2024年7月1日", "2024年1月1日"]
    assert values(spark, D.shown_date_time(c), rows) == ["07/05", "07/06 02:30", "03/01", "2024-02-32", "2024-13-01", "soon", None, "07/01 08:00", "01/01 08:00"]
    assert values(spark, D.shown_list_time(c), rows)[:3] == ["仅披露日期", "02:30", "仅披露日期"]
    assert values(spark, D.shown_sidebar_time(c), rows)[:3] == ["07/05", "02:30", "03/01"]
    assert values(spark, D.machine_readable(c), rows) == [True, False, True, True, True, False, None, True, True]


def test_shown_dates_do_not_depend_on_the_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert values(spark, D.shown_date_time(F.col("c")), ["2024-03-10T07:30:00Z", "2024-07-05"]) == ["03/10 15:30", "07/05"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_days_and_months(spark):
    c = F.col("c")
    assert values(spark, D.day_after(c, 14), ["2024-02-20", "2023-12-31"]) == ["2024-03-05", "2024-01-14"]
    with pytest.raises(Exception, match="not a date"):
        values(spark, D.day_after(c, 1), ["soon"])
    assert [str(d) for d in values(spark, D.months_before(c, 3), ["2024-05-31", "2023-05-31", "2024-07-15"])] == ["2024-03-02", "2023-03-03", "2024-04-15"]
    snapshot = F.lit("2024-07-01")
    assert values(spark, D.in_year_of(c, snapshot), ["2024-01-01", "2023-12-31", "2024"]) == [True, False, False]
    assert values(spark, D.before_year_of(c, snapshot), ["2024-01-01", "2023-12-31", "2024"]) == [False, True, True]


def test_number_text(spark):
    assert values(spark, number_text(F.col("x")), [0.0, 1.005, -1.5, 1234567.891, 100.0, 12.3, None], "x double") == ["0", "1.01", "-1.5", "1,234,567.89", "100", "12.3", None]


def test_dimensions(spark):
    c = F.col("c")
    assert values(spark, X.dimension_id(c), [" tech ", "合规", "Tech", "", None]) == ["technology", "compliance", None, None, None]
    assert values(spark, X.dimension_label(c), [" tech ", " 天气 ", "", None]) == ["技术风险", "天气", "", "未分类风险"]
    names = [["ip", "合规", None, "x", "cyber"], [], None]
    assert values(spark, X.dimension_ids(c), names, "c array<string>") == [["technology", "compliance"], [], None]
    assert values(spark, X.dimension_labels(c), names, "c array<string>") == [["技术风险", "合规风险"], [], None]


def test_redistribution(spark):
    rows = [("天眼查", None), ("用户提供", "天眼查科技"), ("用户提供", ""), (None, None), ("公告", "交易所")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(X.redistribution(F.col("a"), F.col("b"))).collect()] == ["licensed-derived", "licensed-derived", "manual", "public-link-only", "public-link-only"]


def test_remapped_indicators(spark):
    mentions = [("a", 3, "R01"), ("a", 1, "old-1"), ("a", 2, "R02"), ("a", 4, "R01"), ("a", 5, "gone"), ("a", 6, None), ("b", 1, "R03"), ("b", 2, "old-3"), ("c", 1, "gone")]
    m = spark.createDataFrame(mentions, "entity string, position long, indicator_id string")
    status = spark.createDataFrame([("R01", "validated"), ("R02", "observation"), ("R03", "candidate")], "indicator_id string, admission_status string")
    legacy = spark.createDataFrame([("old-1", "R01"), ("old-3", "R03")], "legacy_id string, indicator_id string")
    got = X.remapped_indicators(m, status, legacy)
    assert sorted((r.entity, r.indicator_id, r.first_position, r.mentions) for r in got.collect()) == [("a", "R01", 1, 3), ("a", "R02", 2, 1), ("b", "R03", 1, 2)]
    assert [(r.entity, r.indicator_id, r.ordinal) for r in X.customer_visible(got).orderBy("ordinal").collect()] == [("a", "R01", 1), ("a", "R02", 2)]
    assert [r.indicator_id for r in X.admitted(got).collect()] == ["R01"] and [r.indicator_id for r in X.observed(got).collect()] == ["R02"]
