import hashlib
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from veldt.operators import enrich as E
from veldt.operators import graph as G
from veldt.operators import merge as M
from veldt.operators import sixdim as X
from veldt.operators import validate as R
from veldt.sources import files, partitioned


def workbook(path, rows):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cells = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{"ABCDEF"[j]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if v != "=" else f'<c r="{"ABCDEF"[j]}{i}"><f>1+1</f></c>' for j, v in enumerate(row) if v is not None) + "</row>"
        for i, row in enumerate(rows, 1)
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')


def test_workbook_records_and_errors(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["title"], ["id", "name"], ["1", "x"], ["2", None], ["3", "="]])
    cells = files.workbook_cells(spark, str(tmp_path / "a.xlsx"))
    got = sorted((r["row"], r["id"], r["name"]) for r in files.sheet_records(cells, "S", ["id", "name"]).collect())
    assert got == [(3, "1", "x"), (4, "2", None), (5, "3", None)]
    errors = {(r.row, r.code) for r in files.sheet_errors(cells, "S", ["id", "name"], ["id", "name"]).collect()}
    assert errors == {(4, "required-value"), (5, "required-value"), (5, "formula-without-result")}
    assert files.sheet_errors(cells, "T", ["id"], []).first().code == "missing-sheet"
    assert files.sheet_errors(cells, "S", ["other"], []).first().code == "missing-header"
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    assert files.workbook_cells(spark, str(tmp_path / "b.xlsx")).first().sheet is None


def test_sqlite_json_digest_and_state(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("create table t (a integer, b text)")
        c.executemany("insert into t values (?, ?)", [(1, "p"), (2, None), (3, "q")])
    df = partitioned.sqlite_rows(spark, str(tmp_path / "x.db"), "t", "a > ?", (1,), rows=1)
    assert sorted((r.a, r.b) for r in df.collect()) == [(2, None), (3, "q")]
    (tmp_path / "d.json").write_text('{"rows": [{"k": "a", "n": 1}, {"k": "b"}]}')
    assert [tuple(r) for r in files.json_records(spark, str(tmp_path / "d.json"), "k string, n long", "rows").collect()] == [("a", 1), ("b", None)]
    assert files.file_digests(spark, str(tmp_path / "d.json")).first().sha256 == hashlib.sha256((tmp_path / "d.json").read_bytes()).hexdigest()
    assert files.optional_table(spark, "no_such_table", "a int").count() == 0
    folder = str(tmp_path / "state")
    assert files.read_state(spark, folder, {}, 1, "a long").count() == 0
    files.write_state(df.select("a"), folder, 1)
    moved = files.read_state(spark, folder, {2: lambda d: d.withColumn("z", F.lit("new"))}, 2, "a long, z string")
    assert {(r.a, r.z) for r in moved.collect()} == {(2, "new"), (3, "new")}
    with pytest.raises(ValueError):
        files.read_state(spark, folder, {}, 0, "a long")


def test_provenance_needs_the_same_identity(spark):
    o = spark.createDataFrame([("o1", "c", "i", "2024", " % "), ("o2", "c", "i", "2024", "%"), ("o3", "c", "j", "2024", "%")], "observation_id string, company_id string, indicator_id string, period string, unit string")
    b = spark.createDataFrame([("e1", "c", "i", "2024 ", "%", "o2"), ("e2", "c", "j", "2024", "%", None), ("e1", "c", "j", "2023", "%", None)], "evidence_id string, company_id string, indicator_id string, period string, unit string, observation_id string")
    e = spark.createDataFrame([("e1", True), ("e2", False)], "evidence_id string, effective boolean")
    assert [r.observation_id for r in X.proven(o, b, e).collect()] == ["o2"]


def test_index_needs_four_dimensions_and_rounds_half_up(spark):
    d = spark.createDataFrame([("a", f"d{i}", v) for i, v in enumerate((50, 51, 50, 51))] + [("b", "d0", 90)], "company_id string, dimension_id string, dimension_score long")
    assert {r.company_id: r["index"] for r in X.index(d).collect()} == {"a": 51, "b": None}


def test_seeded_violations_are_found(spark):
    company = spark.createDataFrame([("c1",), ("c2",)], "company_id string")
    indicator = spark.createDataFrame([("R01", "narrative"), ("R05", "weighted")], "indicator_id string, kind string")
    source = spark.createDataFrame([("s1",)], "source_id string")
    columns = "observation_id string, company_id string, indicator_id string, metric_name string, as_of_date string, numeric_value double, confidence double, source_id string"
    good = [("o1", "c1", "R01", "m", "2024", 1.0, 0.5, "s1"), ("o2", "c2", "R05", "m", "2024", 1.0, 1.0, "s1")]
    coverage = spark.createDataFrame([(c, i) for c in ("c1", "c2") for i in ("R01", "R05")], "company_id string, indicator_id string")
    run = lambda obs, cov=coverage, ind=indicator: {(r.rule, r.entity) for r in R.industry_violations(company, ind, spark.createDataFrame(obs, columns), cov, source).collect()}
    assert run(good) == set()
    assert run([*good, ("o3", "c9", "R01", "m", "2024", 1.0, 0.5, "s1")]) == {("observation-company", "o3")}
    assert run([*good, ("o1", "c1", "R01", "n", "2024", 1.0, 0.5, "s1")]) == {("duplicate-observation", "o1")}
    assert run([*good, ("o3", "c1", "R05", "m", "2024", None, 2.0, "s7")]) == {("observation-without-value", "o3"), ("observation-confidence", "o3"), ("observation-source", "o3")}
    assert run(good, coverage.where("not (company_id = 'c1' and indicator_id = 'R05')")) == {("coverage-absent", "c1|R05")}
    assert run(good, ind=spark.createDataFrame([("R01", "weighted"), ("R05", "weighted")], indicator.schema)) == {("wrong-kind", "R01")}


def test_polymorphic_references(spark):
    b = spark.createDataFrame([("b1", "event", "e1"), ("b2", "event", "n1"), ("b3", "node", "n1"), ("b4", "other", "x")], "id string, target_type string, target_id string")
    e, n = spark.createDataFrame([("e1",)], "event_id string"), spark.createDataFrame([("n1",)], "node_id string")
    assert {r.entity for r in R.polymorphic(b, {"event": (e, "event_id"), "node": (n, "node_id")}, "r", "id").collect()} == {"b2", "b4"}


def test_graph_hops_and_subgraph(spark):
    edges = spark.createDataFrame([("e", "d1", "link"), ("d1", "x", "proof"), ("d2", "y", "proof"), ("d1", "d1", "loop")], "source string, target string, kind string")
    start = spark.createDataFrame([("e",)], "id string")
    assert {(r.id, r.hop) for r in G.hops(edges, start, ["link", "proof"]).collect()} == {("e", 0), ("d1", 1), ("x", 2)}
    assert {r.id: r.degree for r in G.degrees(edges).collect()}["d1"] == 3
    nodes = spark.createDataFrame([("e", "event"), ("d1", "dim"), ("x", "proof")], "id string, kind string")
    assert [tuple(r) for r in G.of_kinds(nodes, edges, ["event", "dim"])[1].select("source", "target").orderBy("target", "source").collect()] == [("d1", "d1"), ("e", "d1")]


def test_sanitised_tables_have_no_local_paths(spark):
    df = spark.createDataFrame([(1, "at /Users/me/work/a.pdf and C:\\Users\\me\\b.txt", "{}"), (2, "clean", None)], "id int, note string, result_json string")
    assert M.leaks(df).count() == 1
    out = M.sanitised(df, ["result_json"])
    assert M.leaks(out).count() == 0 and out.where("result_json is not null").count() == 0


def test_enrichment(spark):
    items = spark.createDataFrame([("c", "授权", True), ("c", "失效", False)], "company_id string, status string, granted boolean")
    assert tuple(E.patents(items).first()) == ("c", 1, 1)
    cov = spark.createDataFrame([("c", "R18", "NA-none"), ("c", "R01", "available")], "company_id string, indicator_id string, status string")
    new = spark.createDataFrame([("c", "R18", "proxy"), ("c", "R01", "proxy")], "company_id string, indicator_id string, status string")
    assert {r.indicator_id: r.status for r in E.coverage_filled(cov, new).collect()} == {"R18": "proxy", "R01": "available"}
