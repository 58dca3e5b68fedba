"""Query of workbook rules: a workbook a supplier, each with one planted mistake, or none."""

from __future__ import annotations

from pyspark.sql import functions as F

from veldt.operators import workbook_rules as B
from veldt.plans import catalogue as C
from veldt.registry import query
from veldt.sources import adapter as A

HEAD = 3
_DIMENSION = {v: k for k, v in reversed(B.DIMENSIONS.items())}


def template() -> list[tuple]:
    """Cells of a workbook that nothing is wrong with: sheet, row, column, kind, value."""
    out = [(B.OVERVIEW, 2, 1, "text", "评价时点：2024-07-01"), (B.OVERVIEW, 4, 2, "text", "数据截止: 2024-06-30")]
    for sheet, headers in B.HEADERS.items():
        out += [(sheet, 1, 1, "text", "title"), *((sheet, HEAD, i, "text", h) for i, h in enumerate(headers, 1))]
    body = {s: [[f"{h} {n}" for h in B.HEADERS[s]] for n in (1, 2)] for s in (B.OBSERVATIONS, B.EVENTS, B.RULES, B.GAPS)}
    body[B.COMPANY] = [[f, f"value of {f}", "text", "2024", "E1", "note"] for f in B.COMPANY_FIELDS]
    body[B.INDICATORS] = [[i, _DIMENSION[d], f"name {i}", w, None if n % 6 == 5 else 40 + n, "缺失" if n % 6 == 5 else "部分观测" if n % 2 else "完整观测", 0 if n % 6 == 5 else 0.75 if n % 2 else 1, 0.5, "reason"] for n, (i, d, w) in enumerate(C.FIXED_WEIGHTS)]
    body[B.INDICATORS].append(["合计", None, None, 100, None, None, None, None, None])
    body[B.RELATIONS] = [[f"R{n}", "a", "owns", "b", None if n else 0.5, "2024", "事实", "E1/RULE", 0.25, "note"] for n in range(2)]
    body[B.NARRATIVES] = [[label, "seen", "E1、E2", "low", "yes", "plan", "gap", "不计分"] for label in ("叙事热度—基本面背离", "第三方与自身表述偏差", "关键叙事一致性", "概念股标签关联度")]
    body[B.EVIDENCE] = [[f"E{n}", "title", "A", "press", "2024-01-01", "https://e.example", None, "p. 1", "web", "use"] for n in (1, 2)]
    body[B.CALLS] = [["K1", "2024-07-01", "vendor", "endpoint", "who", 0.5, "use", "result"]]
    for sheet, rows in body.items():
        for n, row in enumerate(rows, HEAD + 1):
            out += [(sheet, n, i, "number" if isinstance(v, int | float) else "text", str(v)) for i, v in enumerate(row, 1) if v is not None]
    return out


def _at(sheet: str, header: str) -> int:
    return B.HEADERS[sheet].index(header) + 1


#: case, sheet, row, header or column: new kind and value (None: no value; '=': a formula without a result), the issues
_I, _N = B.INDICATORS, B.NARRATIVES
CASES: list[tuple] = [
    (1, B.GAPS, None, None, None, None, [(B.GAPS, None, None, "MISSING_SHEET", None)]),
    (2, B.EVENTS, HEAD, "状态", "text", "other", [(B.EVENTS, None, None, "MISSING_REQUIRED_COLUMNS", None)]),
    (3, B.OBSERVATIONS, 4, "期间", None, "=", [(B.OBSERVATIONS, 4, "期间", "FORMULA_RESULT_MISSING", None)]),
    (4, B.EVIDENCE, 5, "标题", "text", "  ", [(B.EVIDENCE, 5, "标题", "REQUIRED_VALUE_MISSING", None)]),
    (5, B.CALLS, 4, "单价(元)", "text", "free", [(B.CALLS, 4, "单价(元)", "NUMBER_REQUIRED", None)]),
    (6, B.OVERVIEW, 4, 2, "text", "数据截止: June", [(B.OVERVIEW, None, None, "ASSESSMENT_DATES_MISSING", None)]),
    (7, _I, 22, "编码", "text", "Z99", [(_I, 22, "编码", "UNKNOWN_INDICATOR_ID", "Z99")]),
    (8, _I, 22, "编码", "text", "C01", [(_I, 22, "编码", "DUPLICATE_INDICATOR_ID", "C01")]),
    (9, _I, 4, "风险维度", "text", "合规风险", [(_I, 4, "风险维度", "INDICATOR_DIMENSION_MISMATCH", None)]),
    (10, _I, 4, "权重(%)", "number", "5", [(_I, 4, "权重(%)", "INDICATOR_WEIGHT_MISMATCH", None), (_I, None, "权重(%)", "WEIGHT_TOTAL_MISMATCH", None)]),
    (11, _I, 4, "数据状态", "text", "maybe", [(_I, 4, "数据状态", "UNKNOWN_DATA_STATUS", None), (_I, None, "权重(%)", "WEIGHT_TOTAL_MISMATCH", None)]),
    (12, _I, 4, "覆盖系数", "number", "0.75", [(_I, 4, "覆盖系数", "COVERAGE_STATUS_MISMATCH", None)]),
    (13, _I, 4, "风险分(0-100)", "number", "100.5", [(_I, 4, "风险分(0-100)", "RISK_SCORE_OUT_OF_RANGE", None)]),
    (14, _I, 9, "风险分(0-100)", "number", "0", [(_I, 9, "风险分(0-100)", "MISSING_INDICATOR_HAS_SCORE", None)]),
    (15, _I, 4, "证据置信度", "number", "-0.1", [(_I, 4, "证据置信度", "CONFIDENCE_OUT_OF_RANGE", None)]),
    (16, _I, 4, "编码", None, None, [(_I, None, "编码", "INDICATOR_SET_INCOMPLETE", "T01"), (_I, None, "权重(%)", "WEIGHT_TOTAL_MISMATCH", None)]),
    (17, _N, 4, "指标", "text", "hype", [(_N, 4, "指标", "UNKNOWN_NARRATIVE_INDICATOR", "hype"), (_N, None, "指标", "NARRATIVE_SET_INCOMPLETE", "N01")]),
    (18, _N, 5, "指标", "text", "叙事热度基本面背离度", [(_N, 5, "指标", "DUPLICATE_NARRATIVE_INDICATOR", "N01"), (_N, None, "指标", "NARRATIVE_SET_INCOMPLETE", "N02")]),
    (19, _N, 6, "处理", "text", "计入评分", [(_N, 6, "处理", "NARRATIVE_SCORING_FORBIDDEN", None)]),
    (20, B.COMPANY, 5, "字段值", None, None, [(B.COMPANY, None, "字段值", "COMPANY_FIELD_MISSING", "企业全称")]),
    (21, B.EVIDENCE, 4, "本地文件", "text", "C:\\x.pdf", [(B.EVIDENCE, 4, "本地文件", "LOCAL_FILE_PATH_IGNORED", None)]),
    (22, None, None, None, None, None, [(None, None, None, "WORKBOOK_READ_FAILED", None)]),
    (23, _I, 4, "评分依据", None, None, [(_I, 4, "评分依据", "REQUIRED_VALUE_MISSING", None)]),
    (24, B.RELATIONS, 4, "关系强度", "bool", "1", [(B.RELATIONS, 4, "关系强度", "NUMBER_REQUIRED", None)]),
]
BOOKS = 500  # workbooks a task makes
KINDS = 27  # of so many suppliers in a row, those beyond the cases have nothing wrong


def workbook_cells(spark, folder):
    """Cells of a workbook for each supplier, changed by the case of its number."""
    cells = spark.createDataFrame(template(), "sheet string, row int, column int, kind string, value string")
    changed = spark.createDataFrame(
        [(c, s, r, _at(s, h) if isinstance(h, str) else h, k, None if v == "=" else v, v == "=", True) for c, s, r, h, k, v, _ in CASES if r is not None],
        "case int, sheet string, row int, column int, new_kind string, new_value string, pending boolean, changed boolean",
    )
    s = A.table(spark, folder, "supplier").select(F.concat(F.lit("book-"), "s_suppkey").alias("path"), (F.col("s_suppkey") % KINDS).cast("int").alias("case"))
    # an appended row for a case that needs one more record, then the template: both have a bounded number of rows
    more = spark.createDataFrame([(c, *x) for c in (7, 8) for x in template() if x[0] == _I and x[1] == 4], "case int, sheet string, row int, column int, kind string, value string").withColumn("row", F.lit(22))
    # some 450 cells come of a row: of the whole table they would be one task
    whole = A.spread(s, A.supplier_count(spark, folder), BOOKS, "path").join(F.broadcast(cells), F.lit(True)).where("NOT (sheet = '指标评分' AND row = 22 AND case IN (7, 8))")
    added = s.join(F.broadcast(more), "case")
    every = whole.unionByName(added.select(whole.columns)).join(F.broadcast(changed), ["case", "sheet", "row", "column"], "left")
    use = F.col("changed").isNotNull()
    out = every.select(
        "path", "sheet", "row", "column", F.when(use, F.col("new_kind")).otherwise(F.col("kind")).alias("kind"), F.when(use, F.col("new_value")).otherwise(F.col("value")).alias("value"),
        F.coalesce("pending", F.lit(False)).alias("pending"), "case",
    )
    # an empty cell that a case fills is in no template
    filled = s.join(F.broadcast(changed.join(cells, ["sheet", "row", "column"], "left_anti")), "case").select(
        "path", "sheet", "row", "column", F.col("new_kind").alias("kind"), F.col("new_value").alias("value"), "pending", "case"
    )
    every = out.unionByName(filled).where(f"NOT (case = 1 AND sheet = '{B.GAPS}') AND case <> 22").drop("case")
    broken = s.where("case = 22").select("path", F.lit(None).cast("string").alias("sheet"), F.lit(0).alias("row"), F.lit(0).alias("column"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("pending"))
    return every.unionByName(broken)


_EXPECTED = C.as_values([(c, *i[:4], "warning" if i[3] == "LOCAL_FILE_PATH_IGNORED" else "error", i[4]) for c, *_, issues in CASES for i in issues])


@query(f"""SELECT 'book-' || s_suppkey AS path, sheet, row_no AS "row", column_name AS "column", code, severity, detail
FROM supplier JOIN (VALUES {_EXPECTED}) e("case", sheet, row_no, column_name, code, severity, detail) ON s_suppkey % {KINDS} = e."case" """)
def workbook_issues(spark, folder):
    return B.workbook_issues(workbook_cells(spark, folder))
