"""Data integration: priority merge of several databases, key remapping, lineage, cleaning, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.text import local_path, portable_path
from veldt.registry import kept


def union_all(tables: list[DataFrame], missing: bool = True) -> DataFrame:
    """All rows of all tables; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), tables)


def by_priority(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of the databases with their name and priority, the first the highest."""
    return union_all([df.withColumn("source_db", F.lit(name)).withColumn("priority", F.lit(i)) for i, (name, df) in enumerate(tables)])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first in the order; combined map-side, no window."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"r.{c}") for c in [*order, *rest]])


def duplicates(df: DataFrame, keys: list[str], order: list[str], identity: str) -> DataFrame:
    """Rows that lost to another of their key, with the identity of the one kept."""
    kept = first_wins(df, keys, order).select(*keys, F.col(identity).alias("kept_id"), *[F.col(c).alias(f"kept_{c}") for c in order])
    lost = df.join(kept, keys)
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"kept_{c}") for c in order])
    return lost.where(~same).select(*keys, identity, "kept_id", *order)


def surrogate_keys(df: DataFrame, order: list[str], start: int, name: str = "key") -> DataFrame:
    """Dense keys from start + 1 on in a fixed order, without pulling all rows into one partition.

    Rows are range-partitioned, counted per partition, and numbered within it.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = kept("surrogate_keys", placed)
    counts = placed.groupBy("_p").count().orderBy("_p").collect()  # one row per partition
    total, rows = start, []
    for r in counts:
        rows.append((r["_p"], total))
        total += r["count"]
    offsets = spark.createDataFrame(rows, "_p int, _offset long") if rows else spark.createDataFrame([], "_p int, _offset long")
    n = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_offset") + n).cast("long")).drop("_p", "_offset")


def remapped(facts: DataFrame, mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Facts whose old key is replaced by its new one; facts without a new key are left out."""
    return facts.join(mapping.select(F.col("old_key").alias(source), F.col("new_key").alias("_new")), source).drop(source).withColumnRenamed("_new", target)


def lineage(df: DataFrame, table: str, key: str, source_key: str) -> DataFrame:
    """Where each row of a merged table came from."""
    return df.select(F.lit(table).alias("table_name"), F.col(key).alias("target_key"), "source_db", F.col(source_key).alias("source_key"))


def linked_sources(observations: DataFrame, links: DataFrame) -> DataFrame:
    """observation_id, source_ids: the primary source first, then its links in order, each once."""
    by = links.groupBy("observation_id").agg(F.sort_array(F.collect_list(F.struct("position", "source_id"))).alias("l"))
    joined = observations.join(by, "observation_id", "left")
    others = F.coalesce(F.transform("l", lambda x: x["source_id"]), F.array().cast("array<string>"))
    own = F.filter(F.array("source_id"), lambda x: x.isNotNull())
    return joined.select("observation_id", F.array_distinct(F.concat(own, others)).alias("source_ids"))


def used_only(sources: DataFrame, users: list[DataFrame], key: str = "source_id") -> DataFrame:
    """Sources that any of the tables refers to."""
    return sources.join(union_all([u.select(key) for u in users]).distinct(), key, "left_semi")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds, counted; empty if the tables are equal."""
    left = a.exceptAll(b).withColumn("only_in", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def score_ready(coverage: DataFrame, members: DataFrame) -> DataFrame:
    """Indicators that are usable for every company of a group; with no company left, all of them are."""
    joined = coverage.join(members, "company_id")
    return joined.groupBy("peer_group_id", "indicator_id").agg(F.bool_and("usable").alias("ready"), F.count("*").alias("companies")).where("ready")


def sanitised(df: DataFrame, drop_payload: list[str] = ()) -> DataFrame:
    """Every text column with local paths rewritten; payload columns emptied."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    columns = []
    for c in df.columns:
        column = F.lit(None).cast("string") if c in drop_payload else portable_path(F.col(c)) if c in texts else F.col(c)
        columns.append(column.alias(c))
    return df.select(*columns)


def leaks(df: DataFrame) -> DataFrame:
    """Rows in which any text column still names a local path."""
    texts = [F.col(f.name) for f in df.schema if f.dataType.simpleString() == "string"]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(local_path(c), F.lit(False)) for c in texts]))


def upserted(state: DataFrame, changes: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """State with changes applied: the last change of a key wins, `keep` columns stay as first written.

    changes has the columns of state and `version`; of changes of one version, the greatest row wins.
    """
    every = state.withColumn("_w", F.lit(0).cast("long")).unionByName(changes.withColumnRenamed("version", "_w"), allowMissingColumns=True)
    rest = [c for c in state.columns if c not in keys and c not in keep]
    by = every.groupBy(*keys).agg(
        F.max(F.struct("_w", *rest)).alias("r"), *[F.min(F.when(F.col(c).isNotNull(), F.struct("_w", c)))[c].alias(c) for c in keep]
    )
    return by.select(*keys, *[F.col(f"r.{c}") for c in rest], *keep)


def patched(state: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """State with the fields that a patch supplies, nulls among them; what it does not supply stays.

    A column `given` of the patch names the fields that each of its rows supplies; a patch without it
    supplies all fields that it has as columns.
    """
    fields = [c for c in state.columns if c not in keys and c in patch.columns]
    given = F.col("given") if "given" in patch.columns else F.array(*map(F.lit, fields))
    p = patch.select(*keys, given.alias("_given"), *[F.col(c).alias(f"_{c}") for c in fields])
    new = {c: F.when(F.array_contains("_given", c), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}
    return state.join(p, keys, "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])


def cleared(state: DataFrame, gone: DataFrame, key: str = "company_id") -> DataFrame:
    """State without anything of some companies."""
    return state.join(gone.select(key).distinct(), key, "left_anti")


def status_set(tasks: DataFrame, task_ids: list[str], status: str, day: str) -> DataFrame:
    """Tasks of which some have another status from a day on."""
    own = F.col("task_id").isin(*task_ids)
    return tasks.withColumns({"status": F.when(own, status).otherwise(F.col("status")), "updated_at": F.when(own, day).otherwise(F.col("updated_at"))})


def cascade_deleted(state: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return state.join(gone.select(key), key, "left_anti"), children.join(gone.select(key), key, "left_anti")


def last_by_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last row of each key at the place of its first."""
    rest = [c for c in df.columns if c not in keys and c != position]
    by = df.groupBy(*keys).agg(F.min(position).alias(position), F.max_by(F.struct(*rest), position).alias("r"))
    return by.select(*keys, position, *[F.col(f"r.{c}") for c in rest])


def ordinal(keys: list[str], order: list[Column], prefix: str, width: int) -> Column:
    """Numbers like SRC-001 in order within a key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))
