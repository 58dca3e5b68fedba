"""Queries of classifiers and of dates as sources write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.functions import dates as D
from veldt.operators import taxonomy as X
from veldt.plans import catalogue as C
from veldt.plans import oracle as O
from veldt.registry import query
from veldt.sources import adapter as A

# ---- dates

_DAY = "regexp_full_match(published, '\\d{4}-\\d{2}-\\d{2}')"
_DATES = f"""d AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m') WHEN 3 THEN '约 ' || strftime(ts, '%Y')
  WHEN 4 THEN '2023-02-' || lpad(CAST(event_id % 35 AS VARCHAR), 2, '0') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') END AS published FROM events),
w AS (SELECT *, {_DAY} AS day, CASE event_id % 6 WHEN 1 THEN date_trunc('second', ts) + INTERVAL 8 HOUR WHEN 2 THEN date_trunc('month', ts) + INTERVAL 8 HOUR WHEN 5 THEN date_trunc('second', ts) WHEN 0 THEN date_trunc('day', ts)
  WHEN 4 THEN CASE WHEN event_id % 35 BETWEEN 1 AND 31 THEN TIMESTAMP '2023-01-31' + to_days(CAST(event_id % 35 AS INT)) END END AS wall FROM d)"""


def _published(spark, folder):
    e = A.table(spark, folder, "events")
    kind, at = F.col("event_id") % 6, lambda f: F.date_format("ts", f)
    text = (
        F.when(kind == 0, at("yyyy-MM-dd")).when(kind == 1, at("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 2, at("yyyy-MM")).when(kind == 3, F.concat(F.lit("约 "), at("yyyy")))
        .when(kind == 4, F.concat(F.lit("2023-02-"), F.lpad((F.col("event_id") % 35).cast("string"), 2, "0"))).otherwise(at("yyyy-MM-dd'T'HH:mm:ss'+08:00'"))
    )
    return e.select("event_id", text.alias("published"))


@query(f"""WITH {_DATES} SELECT event_id, published, wall IS NOT NULL AS valid, day AS only_day, regexp_full_match(published, '\\d{{4}}(-\\d{{2}}(-\\d{{2}})?)?') AS machine_readable,
  coalesce(year(wall) || '年' || month(wall) || '月' || day(wall) || '日', published) AS shown, coalesce(CASE WHEN day THEN strftime(wall, '%m/%d') ELSE strftime(wall, '%m/%d %H:%M') END, published) AS shown_time,
  CASE WHEN day THEN '仅披露日期' ELSE coalesce(strftime(wall, '%H:%M'), published) END AS in_list, coalesce(CASE WHEN day THEN strftime(wall, '%m/%d') ELSE strftime(wall, '%H:%M') END, published) AS in_sidebar FROM (SELECT * FROM w)""".replace("day(wall)", "date_part('day', wall)"))
def source_dates(spark, folder):
    c = F.col("published")
    return _published(spark, folder).select(
        "event_id", c, D.is_date(c).alias("valid"), D.date_only(c).alias("only_day"), D.machine_readable(c).alias("machine_readable"), D.shown_date(c).alias("shown"),
        D.shown_date_time(c).alias("shown_time"), D.shown_list_time(c).alias("in_list"), D.shown_sidebar_time(c).alias("in_sidebar"),
    )


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS n FROM orders)
SELECT o_orderkey, CAST(d + CAST(n AS INT) AS VARCHAR) AS due, CAST(CAST(date_trunc('month', d) - INTERVAL 3 MONTH AS DATE) + CAST(day(d) - 1 AS INT) AS VARCHAR) AS quarter_before, CAST(CAST(date_trunc('month', d) - INTERVAL 6 MONTH AS DATE) + CAST(day(d) - 1 AS INT) AS VARCHAR) AS half_before,
  year(d) = 1995 AS this_year, year(d) < 1995 AS earlier FROM d""")
def order_dates(spark, folder):
    d, snapshot = F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1995-06-17")
    return A.table(spark, folder, "orders").select(
        "o_orderkey", D.day_after(d, (F.col("o_orderkey") % 7).cast("int")).alias("due"), D.months_before(d, 3).cast("string").alias("quarter_before"), D.months_before(d, 6).cast("string").alias("half_before"),
        D.in_year_of(d, snapshot).alias("this_year"), D.before_year_of(d, snapshot).alias("earlier"),
    )


# ---- classifiers

_NAMED = {
    "source_type": "CASE WHEN event_id % 3 = 0 THEN '天眼查付费档案' WHEN event_id % 3 = 1 THEN '用户提供材料' WHEN event_id % 4 = 0 THEN NULL ELSE '交易所公告' END",
    "institution": "CASE WHEN event_id % 10 = 0 THEN '北京天眼查科技' ELSE '上海证券交易所' END",
}


@query(f"""WITH {O.EVENTS}, s AS (SELECT company_id, {_NAMED['source_type']} AS source_type, {_NAMED['institution']} AS institution FROM risk_events)
SELECT company_id, CASE WHEN source_type LIKE '%天眼查%' OR institution LIKE '%天眼查%' THEN 'licensed-derived' WHEN source_type LIKE '%用户提供%' THEN 'manual' ELSE 'public-link-only' END AS redistribution, count(*) AS sources FROM s GROUP BY 1, 2""")
def redistribution_classes(spark, folder):
    s = A.events(spark, folder).select("company_id", *[F.expr(e).alias(n) for n, e in _NAMED.items()])
    return s.groupBy("company_id", X.redistribution(F.col("source_type"), F.col("institution")).alias("redistribution")).agg(F.count("*").alias("sources"))


_ALIASES = [(alias, d) for d, found in X.ALIASES.items() for alias in found]
_NAMES = [alias for alias, _ in _ALIASES] + ["天气", "", "Technology"]
_NAME = "list_extract({names}, CAST(({{at}}) % {n} AS INT) + 1)".format(names="[" + ", ".join(f"'{n}'" for n in _NAMES) + "]", n=len(_NAMES))
_DIM = "CASE {name} " + " ".join(f"WHEN '{a}' THEN '{d}'" for a, d in _ALIASES) + " END"
_LABEL = "CASE {d} " + " ".join(f"WHEN '{d}' THEN '{label}'" for d, label in X.LABELS.items()) + " END"
_AT = ["p_partkey", "p_partkey + 5", "p_partkey * 3 + 1"]


@query(f"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 <> 7 THEN {_NAME.format(at=_AT[0])} END AS a, {_NAME.format(at=_AT[1])} AS b, {_NAME.format(at=_AT[2])} AS c FROM part),
d AS (SELECT *, {_DIM.format(name='a')} AS da, {_DIM.format(name='b')} AS db, {_DIM.format(name='c')} AS dc FROM n),
l AS (SELECT *, CASE WHEN db = da THEN NULL ELSE db END AS eb, CASE WHEN dc = da OR dc = db THEN NULL ELSE dc END AS ec FROM d)
SELECT p_partkey, da AS dimension_id, coalesce({_LABEL.format(d='da')}, a, '未分类风险') AS label, concat_ws('、', da, eb, ec) AS dimensions, concat_ws('、', {_LABEL.format(d='da')}, {_LABEL.format(d='eb')}, {_LABEL.format(d='ec')}) AS labels FROM l""")
def dimension_names(spark, folder):
    names, key = F.array(*map(F.lit, _NAMES)), F.col("p_partkey")
    at = lambda x: F.element_at(names, ((x % len(_NAMES)) + 1).cast("int"))
    padded = F.when(key % 50 != 7, F.concat(F.lit(" "), at(key), F.lit(" ")))
    found = F.array(padded, at(key + 5), at(key * 3 + 1))
    return A.table(spark, folder, "part").select(
        "p_partkey", X.dimension_id(padded).alias("dimension_id"), X.dimension_label(padded).alias("label"), F.array_join(X.dimension_ids(found), "、").alias("dimensions"), F.array_join(X.dimension_labels(found), "、").alias("labels")
    )


# Twenty-two indicators, every third a candidate; ids up to 18 have an older name, two of them unknown ones.
_STATUS = [(f"R{i:02d}", ("candidate", "validated", "observation")[i % 3]) for i in range(1, 23)]
_LEGACY = [(f"kri-{i:03d}", f"R{1 + i % 20:02d}") for i in range(1, 19)]
_MENTIONED = "CASE WHEN event_id % 2 = 0 THEN concat('R', lpad(CAST(event_id * 7 % 26 AS STRING), 2, '0')) ELSE concat('kri-', lpad(CAST(event_id * 5 % 24 AS STRING), 3, '0')) END"
_VISIBLE = f"""{O.EVENTS}, status(indicator_id, admission_status) AS (VALUES {C.as_values(_STATUS)}), legacy(legacy_id, now) AS (VALUES {C.as_values(_LEGACY)}),
m AS (SELECT company_id AS entity, event_id, {_MENTIONED} AS written FROM risk_events),
p AS (SELECT entity, event_id, coalesce(s.indicator_id, now) AS indicator_id FROM m LEFT JOIN status s ON written = s.indicator_id LEFT JOIN legacy ON written = legacy_id),
o AS (SELECT entity, indicator_id, min(event_id) AS first_position, count(*) AS mentions FROM p WHERE indicator_id IS NOT NULL GROUP BY 1, 2),
v AS (SELECT o.*, admission_status FROM o JOIN status USING (indicator_id) WHERE admission_status <> 'candidate')"""


def _visible(spark, folder):
    mentions = A.events(spark, folder).select(F.col("company_id").alias("entity"), F.col("event_id").alias("position"), F.expr(_MENTIONED).alias("indicator_id"))
    indicators = spark.createDataFrame(_STATUS, "indicator_id string, admission_status string")
    return X.customer_visible(X.remapped_indicators(mentions, indicators, spark.createDataFrame(_LEGACY, "legacy_id string, indicator_id string")))


@query(f"WITH {_VISIBLE} SELECT *, row_number() OVER (PARTITION BY entity ORDER BY first_position, indicator_id) AS ordinal FROM v")
def visible_indicators(spark, folder):
    return _visible(spark, folder)


@query(f"WITH {_VISIBLE} SELECT entity, count(*) FILTER (admission_status = 'validated') AS admitted, count(*) FILTER (admission_status = 'observation') AS observed FROM v GROUP BY 1")
def admission_counts(spark, folder):
    v = _visible(spark, folder)
    return v.groupBy("entity").agg(F.count_if(F.col("admission_status") == "validated").alias("admitted"), F.count_if(F.col("admission_status") == "observation").alias("observed"))
