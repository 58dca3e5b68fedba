"""Rules of an assessment workbook, as a table of what is wrong: path, sheet, row, column, code, severity, detail.

A schema of sheets is compiled to checks on rows. Cells of any number of workbooks are judged
together: the header row of each sheet is found, its records are put together, one shuffle by
row, and every check is an expression on a record. Only checks on whole sets (duplicates, missing
members, totals) group records, by workbook.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.plans.catalogue import FIXED_WEIGHTS
from veldt.registry import kept

# Sheets and their headers (fixed values).
OVERVIEW = "风险总览"
COMPANY, INDICATORS, OBSERVATIONS, EVENTS, RELATIONS, NARRATIVES, EVIDENCE, RULES, GAPS, CALLS = (
    "企业主表", "指标评分", "原始观测", "风险事件", "实体关系", "叙事校验", "证据库", "评分规则", "数据缺口", "API调用日志",
)
HEADERS = {
    COMPANY: ["字段", "字段值", "值类型", "数据时点", "证据ID", "说明"],
    INDICATORS: ["编码", "风险维度", "二级指标", "权重(%)", "风险分(0-100)", "数据状态", "覆盖系数", "证据置信度", "评分依据"],
    OBSERVATIONS: ["观测ID", "指标/字段", "期间", "原始值", "单位", "同比/变化", "派生指标", "证据ID", "来源页/段", "值状态"],
    EVENTS: ["事件ID", "事件类型", "事件日期", "对象", "严重度", "状态", "金额/数量", "事件摘要", "证据ID", "模型处理"],
    RELATIONS: ["边ID", "起点实体", "关系", "终点实体", "关系强度", "有效时间", "事实/推断", "证据ID", "传播系数建议", "说明"],
    NARRATIVES: ["指标", "观测", "证据", "定性风险", "可获取性", "自动化方案", "当前缺口", "处理"],
    EVIDENCE: ["证据ID", "标题", "来源层级", "发布机构", "发布日期", "URL", "本地文件", "关键页/段", "采集方式", "用途"],
    RULES: ["模块", "规则", "公式/阈值", "系统字段", "输出", "注意事项"],
    GAPS: ["缺口ID", "指标", "缺失字段", "当前替代口径", "影响", "建议来源", "是否需付费", "优先级"],
    CALLS: ["调用ID", "时间", "供应商", "接口", "查询对象", "单价(元)", "用途", "结果摘要"],
}
#: texts and numbers that every record of a sheet must have, and numbers that may be absent
TEXTS = {
    COMPANY: ["字段"], OBSERVATIONS: ["观测ID", "指标/字段", "期间"], EVENTS: ["事件ID", "事件类型", "事件摘要"], RELATIONS: ["边ID", "起点实体", "关系", "终点实体"],
    EVIDENCE: ["证据ID", "标题"], RULES: ["模块", "规则"], GAPS: ["缺口ID", "指标", "缺失字段"], CALLS: ["调用ID", "供应商", "接口"],
}
NUMBERS = {RELATIONS: ["传播系数建议"], CALLS: ["单价(元)"]}
OPTIONAL_NUMBERS = {RELATIONS: ["关系强度"]}
# Words of the sheets and what they stand for (fixed values).
DIMENSIONS = {
    "技术风险": "technology", "合规风险": "compliance", "财务融资风险": "finance", "财务与融资风险": "finance", "外部环境风险": "external", "人员与治理风险": "personnel-governance",
}
NARRATIVE_IDS = {
    "叙事热度—基本面背离": "N01", "叙事热度基本面背离度": "N01", "第三方与自身表述偏差": "N02", "自身评价一致性/稳定性": "N03", "关键叙事一致性": "N03", "概念股标签关联度": "N04", "概念标签业务支撑度": "N04",
}
STATUSES = {"完整观测": 1.0, "部分观测": 0.75, "缺失": 0.0}
MISSING, TOTAL, NOT_SCORED = "缺失", "合计", "不计分"
COMPANY_FIELDS = ["企业ID", "企业全称", "证券代码"]
ASSESSED, CUTOFF = r"评价时点[：:]\s*(\d{4}-\d{2}-\d{2})", r"数据截止[：:]\s*(\d{4}-\d{2}-\d{2})"
#: rows that may hold the header, and rows of the overview that may hold the dates
HEADER_ROWS, DATE_ROWS = 20, 10


def _normal(c: Column) -> Column:
    """A text with its white space as single blanks."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _issues(df: DataFrame, sheet: str | Column, code: str | Column, column: str | Column | None = None, row: Column | None = None, severity: str = "error", detail: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        "path", lit(sheet).cast("string").alias("sheet"), (F.lit(None) if row is None else row).cast("int").alias("row"), lit(column).cast("string").alias("column"),
        lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def table_heads(cells: DataFrame) -> DataFrame:
    """path, sheet, head (row), columns (map of column to header): the first of the first rows that holds all headers of its sheet."""
    first = cells.where((F.col("row").between(1, HEADER_ROWS)) & F.col("value").isNotNull()).withColumn("header", _normal(F.col("value"))).where("header <> ''")
    # of two columns with one header the later counts
    each = first.groupBy("path", "sheet", "row", "header").agg(F.max("column").alias("column"))
    wanted = F.create_map(*(x for s, hs in HEADERS.items() for x in (F.lit(s), F.array(*map(F.lit, hs)))))
    rows = each.groupBy("path", "sheet", "row").agg(F.collect_set("header").alias("headers"), F.map_from_entries(F.collect_list(F.struct("column", "header"))).alias("columns"))
    need = F.try_element_at(wanted, F.col("sheet"))
    full = rows.where(need.isNotNull() & (F.size(F.array_except(need, F.col("headers"))) == 0))
    return full.groupBy("path", "sheet").agg(F.min_by("columns", "row").alias("columns"), F.min("row").alias("head"))


def records(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """path, sheet, row, cell (map of header to kind, value, pending) of every row under a header that holds a value."""
    under = cells.join(heads, ["path", "sheet"]).where("row > head").withColumn("header", F.try_element_at("columns", F.col("column"))).where("header is not null")
    cell = F.struct("header", F.struct("kind", "value", "pending").alias("cell"))
    rows = under.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(cell)).alias("cell"), F.count("value").alias("n"))
    return rows.where("n > 0").drop("n")


def _value(column: str) -> Column:
    return F.try_element_at("cell", F.lit(column))


def _text(column: str) -> Column:
    """A cell's text, empty where there is none."""
    return F.coalesce(_normal(_value(column)["value"]), F.lit(""))


def _pending(column: str) -> Column:
    return F.coalesce(_value(column)["pending"], F.lit(False))


def _number(column: str) -> Column:
    """A cell's number, null where it is none."""
    return F.when(_value(column)["kind"] == "number", _value(column)["value"].try_cast("double"))


def _found(when: Column, column: str, code: str) -> Column:
    return F.when(when, F.struct(F.lit(column).alias("column"), F.lit(code).alias("code")))


def _needs_text(column: str) -> list[Column]:
    return [_found(_pending(column), column, "FORMULA_RESULT_MISSING"), _found(~_pending(column) & (_text(column) == ""), column, "REQUIRED_VALUE_MISSING")]


def _needs_number(column: str, may_lack: Column | bool = False) -> list[Column]:
    lacks = F.coalesce(_value(column)["value"].isNull(), F.lit(True))
    allowed = lacks & (may_lack if isinstance(may_lack, Column) else F.lit(may_lack))
    return [_found(_pending(column), column, "FORMULA_RESULT_MISSING"), _found(~_pending(column) & _number(column).isNull() & ~allowed, column, "NUMBER_REQUIRED")]


def _by_row(rows: DataFrame, sheet: str, checks: list[Column]) -> DataFrame:
    found = rows.select("path", "row", F.explode(F.array_compact(F.array(*checks))).alias("f"))
    return _issues(found, sheet, F.col("f.code"), F.col("f.column"), F.col("row"))


def _once(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in a workbook, and the others."""
    least = rows.groupBy("path", key).agg(F.min("row").alias("least"))
    both = rows.join(least, ["path", key])
    return both.where("row = least").drop("least"), both.where("row > least").drop("least")


def _absent(paths: DataFrame, seen: DataFrame, key: str, wanted: list[str], sheet: str, code: str, column: str) -> DataFrame:
    """Workbooks in which a key of a set was not seen."""
    known = seen.groupBy("path").agg(F.collect_set(key).alias("seen"))
    lacking = paths.join(known, "path", "left").withColumn("lacking", F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>"))))
    return _issues(lacking.where(F.size("lacking") > 0), sheet, code, column, detail=F.array_join("lacking", "、"))


def indicator_issues(rows: DataFrame, paths: DataFrame) -> DataFrame:
    weights = {i: float(w) for i, _, w in FIXED_WEIGHTS}
    named = rows.withColumn("id", _text("编码")).where((F.col("id") != "") & ~F.col("id").startswith(TOTAL))
    known = F.col("id").isin(list(weights))
    first, again = _once(named.where(known), "id")
    label, status, lacking = _text("风险维度"), _text("数据状态"), _text("数据状态") == MISSING
    dimension, expected = F.try_element_at(_map(DIMENSIONS), label), F.try_element_at(_map({i: d for i, d, _ in FIXED_WEIGHTS}), F.col("id"))
    weight, coverage, score, trust = _number("权重(%)"), _number("覆盖系数"), _number("风险分(0-100)"), _number("证据置信度")
    wanted = F.try_element_at(_map(STATUSES), status)
    outside = lambda c, low, high: (c < low) | (c > high) | F.isnan(c)
    # a record without these is not scored, and its name and reason are not looked at
    scored = dimension.isNotNull() & weight.isNotNull() & wanted.isNotNull() & coverage.isNotNull() & trust.isNotNull()
    checks = [
        *_needs_text("风险维度"), _found(dimension.isNull() | (dimension != expected), "风险维度", "INDICATOR_DIMENSION_MISMATCH"),
        *_needs_number("权重(%)"), _found(weight != F.try_element_at(_map(weights), F.col("id")), "权重(%)", "INDICATOR_WEIGHT_MISMATCH"),
        *_needs_text("数据状态"), _found(wanted.isNull(), "数据状态", "UNKNOWN_DATA_STATUS"),
        *_needs_number("覆盖系数"), _found(coverage != wanted, "覆盖系数", "COVERAGE_STATUS_MISMATCH"),
        *_needs_number("风险分(0-100)", lacking), _found(outside(score, 0, 100), "风险分(0-100)", "RISK_SCORE_OUT_OF_RANGE"),
        _found(lacking & score.isNotNull(), "风险分(0-100)", "MISSING_INDICATOR_HAS_SCORE"),
        *_needs_number("证据置信度"), _found(outside(trust, 0, 1), "证据置信度", "CONFIDENCE_OUT_OF_RANGE"),
        *(F.when(scored, c) for name in ("二级指标", "评分依据") for c in _needs_text(name)),
    ]
    total = first.where(scored).groupBy("path").agg(F.sum(weight).alias("total"))
    off = paths.join(total, "path", "left").withColumn("total", F.coalesce("total", F.lit(0.0))).where("total <> 100")
    return reduce(DataFrame.unionByName, [
        _issues(named.where(~known), INDICATORS, "UNKNOWN_INDICATOR_ID", "编码", F.col("row"), detail=F.col("id")),
        _issues(again, INDICATORS, "DUPLICATE_INDICATOR_ID", "编码", F.col("row"), detail=F.col("id")),
        _by_row(first, INDICATORS, checks),
        _absent(paths, first, "id", sorted(weights), INDICATORS, "INDICATOR_SET_INCOMPLETE", "编码"),
        _issues(off, INDICATORS, "WEIGHT_TOTAL_MISMATCH", "权重(%)"),
    ])


def narrative_issues(rows: DataFrame, paths: DataFrame) -> DataFrame:
    named = rows.withColumn("id", F.try_element_at(_map(NARRATIVE_IDS), _text("指标")))
    first, again = _once(named.where("id is not null"), "id")
    checks = [*_needs_text("处理"), _found(~F.contains(_text("处理"), F.lit(NOT_SCORED)), "处理", "NARRATIVE_SCORING_FORBIDDEN"), *_needs_text("观测"), *_needs_text("定性风险")]
    return reduce(DataFrame.unionByName, [
        _by_row(rows, NARRATIVES, _needs_text("指标")),
        _issues(named.where("id is null"), NARRATIVES, "UNKNOWN_NARRATIVE_INDICATOR", "指标", F.col("row"), detail=_text("指标")),
        _issues(again, NARRATIVES, "DUPLICATE_NARRATIVE_INDICATOR", "指标", F.col("row"), detail=F.col("id")),
        _by_row(first, NARRATIVES, checks),
        _absent(paths, first, "id", sorted(set(NARRATIVE_IDS.values())), NARRATIVES, "NARRATIVE_SET_INCOMPLETE", "指标"),
    ])


def company_issues(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Fields that every company has; of two rows for a field the later counts."""
    value = F.max_by(F.coalesce(_normal(_value("字段值")["value"]), F.lit("")), "row").alias("value")
    filled = rows.where(_text("字段").isin(COMPANY_FIELDS)).groupBy("path", _text("字段").alias("field")).agg(value).where("value <> ''")
    known = filled.groupBy("path").agg(F.collect_set("field").alias("fields"))
    lacking = F.array_except(F.array(*map(F.lit, COMPANY_FIELDS)), F.coalesce("fields", F.array().cast("array<string>")))
    each = paths.join(known, "path", "left").select("path", F.explode(lacking).alias("field"))
    return _issues(each, COMPANY, "COMPANY_FIELD_MISSING", "字段值", detail=F.col("field"))


def workbook_issues(cells: DataFrame) -> DataFrame:
    """What is wrong with workbooks of cells: path, sheet, row, column, kind, value, pending.

    A sheet without cells has a row 0; a file that is no workbook a row without a sheet. A workbook that lacks
    sheets is judged by these and by the headers of the others only.
    """
    cells = kept("workbook_cells", cells)  # every sheet's checks read both
    sheets = cells.groupBy("path").agg(F.collect_set("sheet").alias("sheets"))
    readable = sheets.where(F.size("sheets") > 0)
    wanted = F.array(*map(F.lit, [OVERVIEW, *HEADERS]))
    lacking = readable.withColumn("lacking", F.array_except(wanted, "sheets"))
    whole = lacking.where(F.size("lacking") == 0).select("path")
    heads = table_heads(cells)
    present = readable.select("path", F.explode(F.array_intersect(F.array(*map(F.lit, HEADERS)), "sheets")).alias("sheet"))
    rows = kept("workbook_rows", records(cells, heads).join(whole, "path", "left_semi"))
    of = lambda sheet: rows.where(F.col("sheet") == sheet)
    texts = cells.where((F.col("sheet") == OVERVIEW) & F.col("row").between(1, DATE_ROWS)).groupBy("path").agg(F.max(_normal(F.col("value")).rlike(ASSESSED)).alias("a"), F.max(_normal(F.col("value")).rlike(CUTOFF)).alias("b"))
    undated = whole.join(texts, "path", "left").where(~(F.coalesce("a", F.lit(False)) & F.coalesce("b", F.lit(False))))
    plain = [
        _by_row(of(s), s, [c for h in TEXTS.get(s, []) for c in _needs_text(h)] + [c for h in NUMBERS.get(s, []) for c in _needs_number(h)] + [c for h in OPTIONAL_NUMBERS.get(s, []) for c in _needs_number(h, True)])
        for s in TEXTS
    ]
    return reduce(DataFrame.unionByName, [
        _issues(sheets.where(F.size("sheets") == 0), None, "WORKBOOK_READ_FAILED"),
        _issues(lacking.select("path", F.explode("lacking").alias("sheet")), F.col("sheet"), "MISSING_SHEET"),
        _issues(present.join(heads, ["path", "sheet"], "left_anti"), F.col("sheet"), "MISSING_REQUIRED_COLUMNS"),
        _issues(undated, OVERVIEW, "ASSESSMENT_DATES_MISSING"),
        company_issues(of(COMPANY), whole),
        indicator_issues(of(INDICATORS), whole),
        narrative_issues(of(NARRATIVES), whole),
        *plain,
        _issues(of(EVIDENCE).where(_text("本地文件") != ""), EVIDENCE, "LOCAL_FILE_PATH_IGNORED", "本地文件", F.col("row"), "warning"),
    ])
