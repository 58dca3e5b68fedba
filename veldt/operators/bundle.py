"""Everything of a company in one row: its child tables as arrays of records, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def children(df: DataFrame, into: str, order: list[str], key: str = "company_id") -> DataFrame:
    """key and the array of its rows, sorted by the columns of the order (nulls first), then by the others.

    Rows are gathered by one shuffle; an array holds the rows of one company, not more.
    """
    rest = [c for c in df.columns if c not in (key, *order)]
    record = F.struct(*order, *rest)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(record)).alias(into))


def used_sources(tables: list[tuple[DataFrame, str | None, str | None]], sources: DataFrame, key: str = "company_id") -> DataFrame:
    """key with the rows of sources that its rows name, each once. tables: rows, a column of one source, a column of an array of sources."""
    named = []
    for df, one, many in tables:
        every = F.array() if one is None else F.array(F.col(one))
        if many:
            every = F.concat(every.cast("array<string>"), F.coalesce(F.col(many), F.array().cast("array<string>")))
        named.append(df.select(key, F.explode(every).alias("source_id")).where("source_id IS NOT NULL"))
    return reduce(DataFrame.unionByName, named).distinct().join(sources, "source_id")


def bundle(companies: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]], key: str = "company_id") -> DataFrame:
    """Companies with an array for each child table: name to rows and their order. A company without rows has an empty array.

    Every child is brought to one row a company before it is joined, so that nothing fans out, and all
    joins are by the key that the arrays are already dealt by: one shuffle a child.
    """
    out = companies
    for name, (df, order) in parts.items():
        own = children(df, name, order, key)
        out = out.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def listed(array: str, *fields: str) -> Column:
    """An array of records as text, for tables that hold no arrays: fields joined by colons, records by bars."""
    return F.concat_ws("|", F.transform(F.col(array), lambda r: F.concat_ws(":", *(r[f].cast("string") for f in fields))))
