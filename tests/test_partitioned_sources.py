"""SQLite files and workbooks read and written in parallel."""

import os
import sqlite3
import zipfile
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from veldt.sources import partitioned as P

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets):
    """sheets: name to rows of values; a text '=' is a formula without a result."""

    def cell(v, at):
        if v == "=":
            return f'<c r="{at}"><f>1+1</f></c>'
        if isinstance(v, bool):
            return f'<c r="{at}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, int | float):
            return f'<c r="{at}"><v>{v}</v></c>'
        return f'<c r="{at}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>'

    strings, names, links, bodies = {}, "", "", {}
    for i, (name, rows) in enumerate(sheets.items(), 1):
        names += f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>'
        links += f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>'
        lines = (f'<row r="{n}">' + "".join(cell(v, f"{chr(65 + j)}{n}") for j, v in enumerate(row) if v is not None) + "</row>" for n, row in enumerate(rows, 1))
        bodies[i] = f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_REL}">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
        for i, body in bodies.items():
            z.writestr(f"xl/worksheets/s{i}.xml", body)


@pytest.fixture
def database(tmp_path):
    with sqlite3.connect(tmp_path / "a.db") as c:
        c.execute("create table t (id integer primary key, name text, x real, b blob, odd)")
        c.executemany("insert into t values (?, ?, ?, ?, ?)", [(i, f"n{i % 7}" if i % 5 else None, i / 4, bytes([i % 256]), i) for i in range(1, 1001)])
        c.execute("insert into t values (5000, 'far', 'not a number', null, null)")
        c.execute("create table w (k text primary key, v integer) without rowid")
        c.execute("insert into w values ('a', 1), ('b', null)")
        c.execute("create table empty (a integer)")
    return str(tmp_path / "a.db")


def test_sqlite_is_read_by_ranges_of_rowids(spark, database):
    P.register(spark)
    df = spark.read.format("sqlite").option("dbtable", "t").option("rows", 100).load(database)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("x", "double"), ("b", "binary"), ("odd", "string")]
    assert df.rdd.getNumPartitions() == 50 and df.count() == 1001
    assert df.where("id = 5000").first().asDict() == {"id": 5000, "name": "far", "x": None, "b": None, "odd": None}
    assert sorted(r.id for r in df.where("name = 'n3' and id between 100 and 130").collect()) == [i for i in range(100, 131) if i % 7 == 3 and i % 5]
    assert df.where("name is null").count() == 200 and df.where("x > 249.5 or id = 3").count() == 3
    assert df.where(F.col("name").isin("n1", "far") & F.col("x").isNull()).count() == 1
    w = spark.read.format("sqlite").option("dbtable", "w").load(database)
    assert {tuple(r) for r in w.collect()} == {("a", 1), ("b", None)}
    assert spark.read.format("sqlite").option("dbtable", "empty").load(database).count() == 0
    with pytest.raises(Exception, match="no table"):
        spark.read.format("sqlite").option("dbtable", "none").load(database)


def test_predicates_run_inside_sqlite(spark, database):
    df = P.sqlite_rows(spark, database, "t", "name = ? OR id > ?", ("n3", 998), rows=300)
    assert sorted(r.id for r in df.collect()) == sorted([i for i in range(1, 1001) if (i % 7 == 3 and i % 5) or i > 998] + [5000])
    assert df.where("id = 999").count() == 1 and df.where("id = 5").count() == 0
    reader = P.SqliteReader([database], "t", P.SqliteSource({"path": database, "dbtable": "t"}).schema(), 10, "id = ?", [7])
    text, values = reader.query(P.RowidRange(database, 1, 10))
    assert text.endswith('FROM "t" WHERE rowid BETWEEN ? AND ? AND (id = ?)') and values == [1, 10, 7]


def test_sqlite_sink_and_introspection(spark, tmp_path, database):
    P.register(spark)
    folder = str(tmp_path / "out")
    df = spark.range(1000).selectExpr("id", "concat('n', id) AS name", "id / 8 AS x", "id % 2 = 0 AS even", "date'2024-01-01' AS day")
    df.repartition(3).write.format("sqlite").option("dbtable", "t").mode("append").save(folder)
    assert len(os.listdir(folder)) == 3
    back = spark.read.format("sqlite").option("dbtable", "t").load(folder)
    assert back.count() == 1000 and back.agg(F.sum("x")).first()[0] == sum(range(1000)) / 8
    assert tuple(back.where("id = 7").first()) == (7, "n7", 0.875, 0, "2024-01-01")
    df.limit(5).coalesce(1).write.format("sqlite").option("dbtable", "t").mode("overwrite").save(folder)
    assert len(os.listdir(folder)) == 1 and spark.read.format("sqlite").option("dbtable", "t").load(folder).count() == 5
    broken = df.withColumn("x", F.expr("raise_error('stop')"))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("sqlite").option("dbtable", "t").mode("append").save(folder)
    assert spark.read.format("sqlite").option("dbtable", "t").load(folder).count() == 5  # nothing half written
    found = {(r.table, r.column): (r.place, r.type, r.key) for r in P.table_columns(spark, database).collect()}
    assert found["t", "id"] == (0, "INTEGER", 1) and found["w", "v"] == (1, "INTEGER", 0) and len(found) == 8


def test_workbooks_are_read_by_sheet(spark, tmp_path):
    P.register(spark)
    workbook(tmp_path / "a.xlsx", {"S": [["title"], ["id", "name"], [1, "x & y"], [2.5, None], ["3", "="]], "empty": [], "T": [[True]]})
    workbook(tmp_path / "b.xlsx", {"S": [["other"]]})
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    cells = spark.read.format("workbook").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 5
    got = {(os.path.basename(r.path), r.sheet, r.row, r.column): (r.kind, r.value, r.pending) for r in cells.collect()}
    assert got["a.xlsx", "S", 3, 1] == ("number", "1", False) and got["a.xlsx", "S", 3, 2] == ("text", "x & y", False)
    assert got["a.xlsx", "S", 5, 1] == ("text", "3", False) and got["a.xlsx", "S", 5, 2] == (None, None, True)
    assert got["a.xlsx", "T", 1, 1] == ("bool", "1", False) and ("a.xlsx", "S", 4, 2) not in got
    assert got["a.xlsx", "empty", 0, 0] == (None, None, False) and got["c.xlsx", None, 0, 0] == (None, None, False)
    summary = {os.path.basename(r.path): (r.sheets, r.rows) for r in P.sheet_summary(cells).collect()}
    assert summary == {"a.xlsx": (3, 6), "b.xlsx": (1, 1), "c.xlsx": (None, None)}
