"""Bundles of a company's rows, and tables whose versions survive lost and competing writers."""

import os

import pytest
from pyspark.sql import functions as F

from veldt.operators import bundle as K
from veldt.sources.snapshots import Conflict, VersionedTable

SCHEMA = "k long, v string, made int"


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA)


def rows(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def test_bundles_hold_every_row_once_and_in_order(spark):
    company = spark.createDataFrame([("a",), ("b",), ("c",)], "company_id string")
    obs = spark.createDataFrame([("a", 2, "y", "s1", ["s2"]), ("a", 1, "x", "s2", None), ("b", 1, "z", None, ["s9"]), (None, 1, "lost", "s1", None), ("a", 1, "x", "s2", None)], "company_id string, n int, t string, source_id string, more array<string>")
    event = spark.createDataFrame([("b", 7, "s3")], "company_id string, n int, source_id string")
    source = spark.createDataFrame([("s1", "one"), ("s2", "two"), ("s3", "three")], "source_id string, title string")
    used = K.used_sources([(obs, "source_id", "more"), (event, "source_id", None)], source)
    out = K.bundle(company, {"obs": (obs.drop("source_id", "more"), ["n"]), "events": (event, ["n"]), "sources": (used, ["source_id"])})
    got = {r.company_id: (r.o, r.e, r.s) for r in out.select("company_id", K.listed("obs", "n", "t").alias("o"), K.listed("events", "n").alias("e"), K.listed("sources", "source_id", "title").alias("s")).collect()}
    assert got == {"a": ("1:x|1:x|2:y", "", "s1:one|s2:two"), "b": ("1:z", "7", "s3:three"), "c": ("", "", "")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_versions_changes_and_vacuum(spark, table):
    assert rows(table) == [] and table.versions() == []
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], SCHEMA)
    assert table.commit(first, 0) == 1
    table.upsert(spark.createDataFrame([(2, "B", 2), (4, "d", 2)], SCHEMA), ["k"], ["made"])
    assert rows(table) == [(1, "a", 1), (2, "B", 1), (3, "c", 1), (4, "d", 2)]
    table.patch(spark.createDataFrame([(1, None), (3, "C"), (9, "none")], "k long, v string"), ["k"])
    assert rows(table) == [(1, "a", 1), (2, "B", 1), (3, "C", 1), (4, "d", 2)]
    table.delete(F.col("k") > 3)
    table.clear()
    assert rows(table) == [] and rows(table, 1) == [(1, "a", 1), (2, "b", 1), (3, "c", 1)] and rows(table, 4)[-1] == (3, "C", 1)
    assert table.vacuum(2) == 3 and table.versions() == [4, 5] and rows(table, 4)
    with pytest.raises(ValueError):
        table.read(1)


def test_a_writer_lost_between_data_and_manifest_changes_nothing(spark, table, monkeypatch):
    table.commit(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(table, "_publish", stop)
        with pytest.raises(KeyboardInterrupt):
            table.commit(spark.createDataFrame([(2, "b", 1)], SCHEMA), 1)
    assert rows(table) == [(1, "a", 1)] and table.versions() == [1]
    assert len(os.listdir(f"{table.folder}/data")) == 2  # the lost rows are there, and in no version
    assert table.commit(spark.createDataFrame([(3, "c", 1)], SCHEMA), 1) == 2 and rows(table) == [(3, "c", 1)]


def test_of_two_writers_the_second_is_told_and_tries_again(spark, table):
    table.commit(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    other = VersionedTable(spark, table.folder, SCHEMA)
    with pytest.raises(Conflict):
        table.commit(spark.createDataFrame([(9, "late", 1)], SCHEMA), 0)
    met = []

    def slow(old):
        if not met:
            met.append(1)
            other.upsert(spark.createDataFrame([(2, "b", 1)], SCHEMA), ["k"])
        return old.withColumn("v", F.upper("v"))

    assert table.change(slow) == 3 and rows(table) == [(1, "A", 1), (2, "B", 1)]
    assert not [f for f in os.listdir(f"{table.folder}/_versions") if f.startswith("_")]


def test_migrations_newer_schemas_and_broken_manifests(spark, table):
    table.commit(spark.createDataFrame([(1, "a", 1)], SCHEMA), 0)
    newer = VersionedTable(spark, table.folder, SCHEMA + ", w string", 3, {1: lambda d: d.withColumn("w", F.lit("x")), 2: lambda d: d.withColumn("w", F.concat("w", F.lit("y")))})
    assert rows(newer) == [(1, "a", 1, "xy")]
    newer.upsert(spark.createDataFrame([(2, "b", 2, "z")], SCHEMA + ", w string"), ["k"])
    with pytest.raises(ValueError, match="newer"):
        table.read()
    for text in ("{", "[]", ""):
        with open(f"{table.folder}/_versions/00000003.json", "w") as f:
            f.write(text)
        if os.path.exists(crc := f"{table.folder}/_versions/.00000003.json.crc"):
            os.remove(crc)
        assert newer.latest() == 2 and newer.versions() == [1, 2]
    assert rows(newer) == [(1, "a", 1, "xy"), (2, "b", 2, "z")]
    assert len([f for f in os.listdir(f"{table.folder}/_versions") if ".invalid-" in f and not f.startswith(".")]) == 3
