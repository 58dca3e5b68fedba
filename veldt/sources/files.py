"""Sources and sinks: tables that may be absent, JSON, binary files with digests, workbooks, state."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def optional_table(spark: SparkSession, name: str, schema: str | StructType) -> DataFrame:
    """A catalogue table, or an empty one of the schema if there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def key_values(df: DataFrame, bound: int = 10_000) -> dict[str, str]:
    """A small table of key and value as a dictionary; more than `bound` rows are an error."""
    rows = df.select("key", "value").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} keys")
    return {r["key"]: r["value"] for r in rows}


def json_records(spark: SparkSession, path: str, schema: str, member: str | None = None) -> DataFrame:
    """Records of multi-line JSON files; of an array member if one is named."""
    if member is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    whole = spark.read.schema(f"`{member}` array<struct<{schema}>>").json(path, multiLine=True)
    return whole.select(F.inline(F.col(member)))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _cells(raw: bytes) -> Iterator[tuple[str, int, int, str | None, bool]]:
    """(sheet, row, column, value, formula without a cached result) of each cell, from 1."""
    book = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.iter(f"{_MAIN}si")]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(f"{_REL}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for cell in root.iter(f"{_MAIN}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = 0
            for letter in letters:
                column = column * 26 + ord(letter) - 64
            kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
            value = None if v is None else v.text
            if kind == "s" and value is not None:
                value = shared[int(value)]
            elif kind == "inlineStr":
                value = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif kind == "e":
                value = None
            yield sheet.get("name"), int(row), column, value, cell.find(f"{_MAIN}f") is not None and v is None


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all workbooks under a path: path, sheet, row, column, value, pending.

    A file that is no workbook gives one row with a null sheet.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = list(_cells(raw))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows = [(None, 0, 0, None, False)]
                yield pd.DataFrame(rows, columns=["sheet", "row", "column", "value", "pending"]).assign(path=name)[["path", "sheet", "row", "column", "value", "pending"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet string, row int, column int, value string, pending boolean")


def sheet_records(cells: DataFrame, sheet: str, headers: list[str], first_rows: int = 20) -> DataFrame:
    """Records of one sheet: the header row is the first of the first rows that holds all headers."""
    own = cells.where(F.col("sheet") == sheet)
    found = own.where((F.col("row") <= first_rows) & F.trim("value").isin(headers)).groupBy("path", "row").agg(F.count_distinct(F.trim("value")).alias("n"), F.map_from_entries(F.collect_list(F.struct("column", F.trim("value")))).alias("names"))
    head = found.where(F.col("n") == len(headers)).groupBy("path").agg(F.min_by("names", "row").alias("names"), F.min("row").alias("head"))
    body = own.join(F.broadcast(head), "path").where("row > head").withColumn("name", F.try_element_at("names", F.col("column")))
    return body.where("name is not null").groupBy("path", "row").pivot("name", headers).agg(F.first("value"))


def sheet_errors(cells: DataFrame, sheet: str, headers: list[str], required: list[str]) -> DataFrame:
    """(sheet, row, column, code) of what is wrong with a sheet; empty if it can be imported."""
    spark = cells.sparkSession
    named = lambda row, column, code: (F.lit(sheet).alias("sheet"), row.alias("row"), column.alias("column"), F.lit(code).alias("code"))
    present = cells.where(F.col("sheet") == sheet)
    if present.limit(1).count() == 0:
        return spark.range(1).select(*named(F.lit(0), F.lit(""), "missing-sheet"))
    records = sheet_records(cells, sheet, headers)
    if records.limit(1).count() == 0:
        return spark.range(1).select(*named(F.lit(0), F.lit(""), "missing-header"))
    empty = F.explode(F.array_compact(F.array(*(F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) == 0, F.lit(c)) for c in required)))).alias("c")
    blank = records.select("row", empty).select(*named(F.col("row"), F.col("c"), "required-value"))
    pending = present.where("pending").select(*named(F.col("row"), F.col("column").cast("string"), "formula-without-result"))
    return blank.unionByName(pending)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_state(df: DataFrame, folder: str, version: int) -> None:
    """State rows under their schema version."""
    df.withColumn("schema_version", F.lit(version)).write.mode("overwrite").partitionBy("schema_version").parquet(folder)


def read_state(spark: SparkSession, folder: str, migrations: dict, version: int, schema: str) -> DataFrame:
    """State at the current version: rows of older ones go through their migrations; newer ones are an error."""
    try:
        whole = spark.read.parquet(folder)
    except Exception as e:  # an empty or absent folder holds no state
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise
    newest = whole.agg(F.max("schema_version")).first()[0]
    if newest is not None and newest > version:
        raise ValueError(f"state of version {newest} is newer than {version}")
    out = None
    for v in range(1, version + 1):
        part = whole.where(F.col("schema_version") == v).drop("schema_version")
        out = part if out is None else migrations.get(v, lambda d: d)(out).unionByName(part, allowMissingColumns=True)
    return out
