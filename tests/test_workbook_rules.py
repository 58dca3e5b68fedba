"""Workbook rules on single workbooks: every planted case, and what the query's workbooks don't hold."""

import pytest

from tests.test_partitioned_sources import workbook
from veldt.operators import workbook_rules as B
from veldt.plans.workbook_queries import CASES, template
from veldt.sources import partitioned as P
from veldt.sources.partitioned import CELLS


def book(spark, *books):
    rows = [(f"b{i}", *cell, False) for i, cells in enumerate(books) for cell in cells]
    return spark.createDataFrame(rows, CELLS)


def found(df):
    return sorted((r.path, r.code, r.row, r.column) for r in B.workbook_issues(df).collect())


def test_every_code_is_planted_once_and_a_clean_workbook_has_none(spark):
    codes = {i[3] for *_, issues in CASES for i in issues}
    assert len(codes) == 24 and found(book(spark, template())) == [] and found(book(spark)) == []


def test_later_headers_win_and_rows_of_nothing_are_skipped(spark):
    cells = template()
    cells += [(B.GAPS, 3, 20, "text", " 指标 ")]  # the later of two columns counts, and it is empty
    cells += [(B.RULES, 9, 30, "text", "under no header")]
    got = found(book(spark, cells))
    assert got == [("b0", "REQUIRED_VALUE_MISSING", 4, "指标"), ("b0", "REQUIRED_VALUE_MISSING", 5, "指标")]


def test_a_lacking_sheet_stops_all_but_header_checks(spark):
    lacking = [c for c in template() if c[0] != B.CALLS and not (c[0] == B.RULES and c[1] == 3) and not (c[0] == B.INDICATORS and c[1] > 10)]
    assert found(book(spark, lacking)) == [("b0", "MISSING_REQUIRED_COLUMNS", None, None), ("b0", "MISSING_SHEET", None, None)]
    late = [(s, r + 18 if s == B.RULES else r, *rest) for s, r, *rest in template()]
    assert [x[1] for x in found(book(spark, late))] == ["MISSING_REQUIRED_COLUMNS"]  # the header is below the first rows


@pytest.mark.parametrize("formula", [True, False])
def test_real_files(spark, tmp_path, formula):
    sheets = {s: [] for s in [B.OVERVIEW, *B.HEADERS]}
    for sheet, row, column, kind, value in template():
        rows = sheets[sheet]
        while len(rows) < row:
            rows.append([])
        while len(rows[row - 1]) < column:
            rows[row - 1].append(None)
        rows[row - 1][column - 1] = float(value) if kind == "number" else value
    if formula:
        sheets[B.CALLS][3][5] = "="
    workbook(tmp_path / "a.xlsx", sheets)
    (tmp_path / "b.xlsx").write_bytes(b"none")
    P.register(spark)
    got = [x[1:] for x in found(spark.read.format("workbook").load(str(tmp_path)))]
    assert got == ([("FORMULA_RESULT_MISSING", 4, "单价(元)")] if formula else []) + [("WORKBOOK_READ_FAILED", None, None)]
