from pyspark.sql import functions as F

from veldt.plans import workbook_queries as Q


def _suppliers(spark, folder, n):
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name"), (F.col("id") % 25).cast("int").alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def _largest(df):
    """Rows of the largest partition."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_no_task_makes_all_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "BOOKS", 10, raising=False)
    cells = Q.workbook_cells(spark, _suppliers(spark, tmp_path, 108))
    assert cells.select("path").distinct().count() == 108
    assert _largest(cells) < cells.count() / 4


def _star(spark, folder, n):
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey"), F.concat(F.lit("N"), "id").alias("n_name"), (F.col("id") % 5).cast("int").alias("n_regionkey")).write.parquet(f"{folder}/nation.parquet")
    spark.range(5).select(F.col("id").cast("int").alias("r_regionkey"), F.concat(F.lit("R"), "id").alias("r_name")).write.parquet(f"{folder}/region.parquet")
    return _suppliers(spark, folder, n)


def test_no_task_hashes_all_requests(spark, tmp_path, monkeypatch):
    from veldt.plans import graph_queries as G

    monkeypatch.setattr(G, "HASHED", 10, raising=False)
    runs = G.run_ids(spark, _star(spark, tmp_path, 108))
    assert runs.count() == 108 * 18
    assert _largest(runs) < 108 * 18 / 4
