"""SQLite files and workbooks as data sources that read and write in parallel.

A SQLite table is planned as ranges of rowids, a workbook as its sheets; each range or sheet is a
partition, streamed by its own task, and nothing passes through the driver but the plan. A predicate
given with the source is SQLite's to evaluate. Files must lie in a folder that all executors see.

    register(spark)
    spark.read.format("sqlite").option("dbtable", "t").load("/shared/x.db")
    df.write.format("sqlite").option("dbtable", "t").mode("append").save("/shared/folder")
    spark.read.format("workbook").load("/shared/books")
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: rows that a task holds at once
BATCH = 10_000


def register(spark: SparkSession) -> None:
    """Make the sources known to a session."""
    for source in (SqliteSource, WorkbookSource):
        spark.dataSource.register(source)


def _local(path: str) -> str:
    return re.sub(r"^file:(//)?", "", path)


def _files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    path = _local(path)
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(suffixes) and not f.startswith((".", "_", "~")))
    return [path]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# ---- SQLite

_TYPES = (("INT", T.LongType()), ("CHAR", T.StringType()), ("CLOB", T.StringType()), ("TEXT", T.StringType()), ("BLOB", T.BinaryType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()))


def column_type(declared: str) -> T.DataType:
    """Spark's type of a declared SQLite type, by SQLite's own rule of affinity; what is left is text."""
    return next((t for part, t in _TYPES if part in declared.upper()), T.StringType())


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


@dataclass
class RowidRange(D.InputPartition):
    path: str
    first: int | None  # a table without rowids is one partition
    last: int | None


class SqliteSource(D.DataSource):
    """Options: path (a file, or a folder of .db files of one schema), dbtable, rows (rowids a partition).

    where, params: a predicate that SQLite evaluates in each range, and the values of its question marks as a
    JSON list. Filters of the DataFrame are Spark's own: Spark 4.1 keeps what was pushed into a Python source for
    the next query on the same DataFrame, which would lose rows there.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _table(self) -> str:
        return self.options["dbtable"]

    def schema(self) -> T.StructType:
        files = _files(self.options["path"], (".db", ".sqlite"))
        if not files:
            raise FileNotFoundError(f"no database in {self.options['path']}")
        with _connect(files[0]) as c:
            found = c.execute(f"PRAGMA table_info({_quoted(self._table())})").fetchall()
        if not found:
            raise ValueError(f"no table {self._table()}")
        return T.StructType([T.StructField(r[1], column_type(r[2]), True) for r in found])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(_files(self.options["path"], (".db", ".sqlite")), self._table(), schema, int(self.options.get("rows", 100_000)), self.options.get("where", ""), json.loads(self.options.get("params", "[]")))

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(_local(self.options["path"]), self._table(), schema, overwrite)


class SqliteReader(D.DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: T.StructType, rows: int, where: str = "", params: list | None = None):
        self.files, self.table, self.schema, self.rows, self.where, self.params = files, table, schema, rows, where, params or []

    def partitions(self) -> list[RowidRange]:
        out = []
        for path in self.files:
            with _connect(path) as c:
                try:
                    low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    out.append(RowidRange(path, None, None))
                    continue
            if low is not None:
                out += [RowidRange(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out or [RowidRange("", None, None)]

    def query(self, part: RowidRange) -> tuple[str, list]:
        where, values = ([f"({self.where})"], self.params) if self.where else ([], [])
        if part.first is not None:
            where, values = ["rowid BETWEEN ? AND ?", *where], [part.first, part.last, *values]
        names = ", ".join(map(_quoted, self.schema.names))
        return f"SELECT {names} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values

    def read(self, partition: RowidRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        arrow = to_arrow_schema(self.schema)
        with _connect(partition.path) as c:
            cursor = c.execute(*self.query(partition))
            while rows := cursor.fetchmany(BATCH):
                columns = [[_fitted(v, f.dataType) for v in col] for col, f in zip(zip(*rows, strict=True), self.schema, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(columns, arrow.types, strict=True)], schema=arrow)


def _fitted(v, kind: T.DataType):
    """A stored value as the column's type; what does not fit is null, except that anything can be text."""
    if v is None or isinstance(kind, T.StringType):
        return v if v is None or isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)
    if isinstance(kind, T.BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    if isinstance(kind, T.LongType):
        return v if isinstance(v, int) else None
    return float(v) if isinstance(v, int | float) else None


@dataclass
class Written(D.WriterCommitMessage):
    path: str


class SqliteWriter(D.DataSourceWriter):
    """Each task fills a database of its own; the commit gives them their names, and only then do readers see them."""

    def __init__(self, folder: str, table: str, schema: T.StructType, overwrite: bool):
        self.folder, self.table, self.schema, self.overwrite = folder, table, schema, overwrite

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"_{uuid.uuid4().hex}.tmp")
        kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
        columns = ", ".join(f"{_quoted(f.name)} {kinds.get(f.dataType.simpleString(), 'TEXT')}" for f in self.schema)
        plain = (int, float, str, bytes, type(None))
        c = sqlite3.connect(path)
        try:
            c.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            insert = f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})"
            c.executemany(insert, ([v if isinstance(v, plain) else str(v) for v in row] for row in iterator))
            c.commit()
        finally:
            c.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        before = _files(self.folder, (".db",)) if self.overwrite else []
        for m in messages:
            if m:
                os.replace(m.path, os.path.join(self.folder, f"part-{os.path.basename(m.path)[1:-4]}.db"))
        for path in before:
            os.remove(path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


def table_columns(spark: SparkSession, path: str) -> DataFrame:
    """file, table, place, column, type, not_null, key of all tables of the databases under a path, a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(0).to_pylist():
                with _connect(file) as c:
                    for (table,) in c.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
                        rows += [(file, table, r[0], r[1], r[2], bool(r[3]), r[5]) for r in c.execute(f"PRAGMA table_info({_quoted(table)})")]
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int32())
            names = ["file", "table", "place", "column", "type", "not_null", "key"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    files = _files(path, (".db", ".sqlite"))
    df = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files)), "file")
    return df.mapInArrow(run, "file string, table string, place int, column string, type string, not_null boolean, key int")


def sqlite_rows(spark: SparkSession, path: str, table: str, where: str = "", params: tuple = (), rows: int = 100_000) -> DataFrame:
    """Rows of a table that a predicate with question marks holds for; the predicate runs inside SQLite."""
    register(spark)
    return spark.read.format("sqlite").options(dbtable=table, rows=rows, where=where, params=json.dumps(list(params))).load(path)


# ---- workbooks

CELLS = "path string, sheet string, row int, column int, kind string, value string, pending boolean"


@dataclass
class Sheet(D.InputPartition):
    path: str
    name: str | None  # a file that is no workbook is one row without a sheet
    target: str


class WorkbookSource(D.DataSource):
    """Cells of all sheets: path, sheet, row, column (from 1), kind, value, pending.

    kind: number, text, bool, or null for empty cells and errors; pending: a formula without a kept result.
    A sheet without cells gives one row with row 0; a file that is no workbook one row without a sheet.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(_files(self.options["path"], (".xlsx", ".xlsm")))


class WorkbookReader(D.DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[Sheet]:
        out = []
        for path in self.files:
            try:
                with zipfile.ZipFile(path) as book:
                    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
                    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
                        target = links[s.get(f"{_REL}id")]
                        out.append(Sheet(path, s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                out.append(Sheet(path, None, ""))
        return out or [Sheet("", None, "")]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        path, sheet = partition.path, partition.name
        if sheet is None:
            if path:
                yield path, None, 0, 0, None, None, False
            return
        found = False
        with zipfile.ZipFile(path) as book:
            shared = []
            if "xl/sharedStrings.xml" in book.namelist():
                with book.open("xl/sharedStrings.xml") as f:
                    for _, e in ElementTree.iterparse(f):
                        if e.tag == f"{_MAIN}si":
                            shared.append("".join(t.text or "" for t in e.iter(f"{_MAIN}t")))
                            e.clear()
            with book.open(partition.target) as f:
                for _, e in ElementTree.iterparse(f):
                    if e.tag == f"{_MAIN}row":
                        e.clear()
                    elif e.tag == f"{_MAIN}c":
                        found = True
                        yield path, sheet, *_cell(e, shared)
        if not found:
            yield path, sheet, 0, 0, None, None, False


def _cell(cell: ElementTree.Element, shared: list[str]) -> tuple:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter) - 64
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    value = None if v is None else v.text
    if kind == "s" and value is not None:
        value = shared[int(value)]
    elif kind == "inlineStr":
        value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    elif kind == "e":
        value = None
    names = {"n": "number", "b": "bool"}
    pending = cell.find(f"{_MAIN}f") is not None and v is None
    return int(row), column, None if value is None else names.get(kind, "text"), value, pending


def sheet_summary(cells: DataFrame) -> DataFrame:
    """Per workbook: its sheets, and its rows with a value; null for a file that is no workbook."""
    filled = F.when(F.col("value").isNotNull(), F.struct("sheet", "row"))
    out = cells.groupBy("path").agg(F.count_distinct("sheet").alias("sheets"), F.count_distinct(filled).alias("rows"), F.count("sheet").alias("known"))
    return out.select("path", F.when(F.col("known") > 0, F.col("sheets")).alias("sheets"), F.when(F.col("known") > 0, F.col("rows")).alias("rows"))
