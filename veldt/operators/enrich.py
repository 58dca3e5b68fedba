"""Derived metrics: news shares, patents, suppliers, penalties, lawsuits, persons, debt cost, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.numeric import half_up
from veldt.functions.text import first_number

# Fixed patterns.
ADVERSE_PATENT = "无效|终止|失效|驳回|撤回"


def news(items: DataFrame) -> DataFrame:
    """Per company: items, shares of positive, negative and keyword items, tone balance, distinct media; 6 decimals.

    items: company_id, sentiment (positive, negative or other), keyword (boolean), media_name.
    """
    by = items.groupBy("company_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("sentiment") == "positive").alias("p"), F.count_if(F.col("sentiment") == "negative").alias("m"),
        F.count_if("keyword").alias("k"), F.count_distinct("media_name").alias("media"),
    )
    share = lambda x: half_up(x * 100.0 / F.greatest(F.col("n"), F.lit(1)), 6)
    return by.select(
        "company_id", "n", "media", share(F.col("p")).alias("positive_share"), share(F.col("m")).alias("negative_share"), share(F.col("k")).alias("keyword_share"), share(F.col("p") - F.col("m")).alias("tone_balance"),
    )


def patents(items: DataFrame) -> DataFrame:
    """Granted and adverse patents per company. items: company_id, status, granted (boolean)."""
    return items.groupBy("company_id").agg(F.count_if("granted").alias("granted"), F.count_if(F.col("status").rlike(ADVERSE_PATENT)).alias("adverse"))


def suppliers(items: DataFrame) -> DataFrame:
    """Domestic and unresolved suppliers and the sum of their shares. items: company_id, base, city, ratio (text)."""
    filled = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    domestic = filled(F.col("base")) | filled(F.col("city"))
    return items.groupBy("company_id").agg(
        F.count("*").alias("disclosed"), F.count_if(domestic).alias("domestic"), F.count_if(~domestic).alias("unresolved"), F.coalesce(F.sum(first_number(F.col("ratio"))), F.lit(0.0)).alias("ratio_sum")
    )


def risk_total(payload: Column) -> Column:
    """Sum of the counts of a JSON list at result.riskList; 0 where there is none."""
    rows = F.from_json(F.get_json_object(payload, "$.result.riskList"), "array<struct<count:long>>")
    return F.coalesce(F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["count"], F.lit(0).cast("long"))), F.lit(0).cast("long"))


def money_sum(items: DataFrame) -> DataFrame:
    """Sum of the amounts that parse, per company."""
    return items.groupBy("company_id").agg(F.coalesce(F.sum(first_number(F.col("amount"))), F.lit(0.0)).alias("amount"))


def debt_cost(interest: Column, debt: Column, debt_before: Column) -> Column:
    """Interest over the mean of two debts, percent."""
    return F.try_divide(interest, (debt + debt_before) / 2) * 100


def nested_number(payload: Column, path: str) -> Column:
    """A whole number of a JSON text; 0 where there is none."""
    return F.coalesce(F.get_json_object(payload, path).try_cast("long"), F.lit(0).cast("long"))


# What tells an administrative penalty about personal data.
PRIVACY = "网络安全|数据安全|个人信息|隐私|算法|网信|信息保护"


def privacy_penalties(items: DataFrame) -> DataFrame:
    """Penalties per company whose record, as a whole, speaks of personal data. items: company_id and any other columns."""
    return items.groupBy("company_id").agg(F.count_if(F.to_json(F.struct(*items.columns)).rlike(PRIVACY)).alias("privacy_penalties"), F.count("*").alias("penalties"))


def person_risks(items: DataFrame, counters: list[str]) -> DataFrame:
    """Sum of a person's risk counters, nulls as 0, per company."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counters[1:]), F.coalesce(F.col(counters[0]), F.lit(0)))
    return items.groupBy("company_id").agg(F.sum(total).alias("person_risks"))


def clues(items: DataFrame, pattern: str, most: int = 3, label: str = "title", joint: str = "；") -> DataFrame:
    """Items whose title or summary matches, per company, and the labels of the newest joined."""
    hit = items.where(F.concat_ws(" ", "title", "summary").rlike(pattern))
    w = Window.partitionBy("company_id").orderBy(F.col("date").desc(), label)
    top = hit.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.col(label).alias("label")))), lambda x: x["label"]), joint)
    return hit.groupBy("company_id").agg(F.count("*").alias("clues")).join(top.groupBy("company_id").agg(text.alias("excerpt")), "company_id")


def coverage_filled(coverage: DataFrame, new: DataFrame) -> DataFrame:
    """Coverage rows with what an enrichment found; an absent status gives way, another stays."""
    n = new.select("company_id", "indicator_id", F.col("status").alias("_s"))
    joined = coverage.join(n, ["company_id", "indicator_id"], "left")
    status = F.when(F.col("status").startswith("NA") & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_s")


# Categories of a file by its name, in order, the last for all others; its class; its formats.
CATEGORIES = (
    ("风险指标|可审计工作簿", "risk-workbook"),
    ("年报|招股书", "annual-reporting"),
    ("财务报表|主营构成", "financial-reporting"),
    ("专利|商标|软件著作权", "intellectual-property"),
    ("供应商|客户|竞品|中标|招标", "commercial-relations"),
    ("开庭|裁判|立案", "litigation"),
    ("行政许可|税务信用|进出口信用|资质证书|监管措施", "regulatory-compliance"),
    ("融资|并购|投资|参控股|发行股票|定向增发|理财", "financing-investment"),
    ("人员|团队|控制人|受益人|股东|变更记录|工商信息", "corporate-governance"),
    (r"(?i)\.zip$", "archive"),
    ("", "company-profile"),
)
CLASSES = (("风险指标|可审计工作簿", "team-workbook"), ("年报|招股书", "public-filing"), (r"(?i)\.zip$", "private-archive"), ("", "commercial-data-export"))
FORMATS = ("xlsx", "pdf", "zip")


def first_match(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The value of the first pattern that a text holds; the last pattern is empty, for all others."""
    out = None
    for pattern, value in table[:-1]:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out.otherwise(table[-1][1])


def catalogued(files: DataFrame) -> DataFrame:
    """category, class and format of each file by its name; another format is an error. files: path."""
    name = F.element_at(F.split("path", "/"), -1)
    form = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(form.isin(*FORMATS), form).otherwise(F.raise_error(F.concat(F.lit("unknown file type: "), "path")))
    return files.select("*", first_match(name, CATEGORIES).alias("category"), first_match(name, CLASSES).alias("class"), known.alias("format"))
