"""Registry of queries: each a function of (spark, folder), with SQL for DuckDB where it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


#: name to the application that keeps a table under it, and the table
_KEPT: dict[str, tuple[str, DataFrame]] = {}


def kept(name: str, df: DataFrame) -> DataFrame:
    """df, cached until the next table is kept under the name, so that an application's storage does not fill up.

    What an application kept that has ended since is gone with it.
    """
    application = df.sparkSession.sparkContext.applicationId
    before = _KEPT.pop(name, None)
    if before and before[0] == application:
        before[1].unpersist()
    _KEPT[name] = application, df.persist()
    return df


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
