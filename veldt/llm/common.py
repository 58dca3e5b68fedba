"""Helpers shared by the training-data operators: checkpoints, running totals, blob codec."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder is made and set, but only for a local master: on a
    cluster executors would not share it.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="veldt-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def running_totals(
    df: DataFrame, group: list[str], value: str, tie: list[str], rows: int, into: str = "before", slim: DataFrame | None = None,
    place: str | None = None, places: int = 1,
) -> DataFrame:
    """Add the sum of `value` over the rows of the same group that come earlier.

    Order within a group: a hash of the `tie` columns, or the number `place`, from 0 to under `places`, then the
    `tie` columns. No window holds a whole
    group: rows fall into hash-ordered buckets, bucket sums are accumulated (about sqrt(rows) of
    them a group), and only a bucket's own rows are ordered, so that a group with a third of all
    rows is spread like any other. Null groups are a group. `slim`, if given, has the same rows with
    only the columns named, for the bucket sums.
    """
    bits = max(10, math.ceil(math.log2(max(rows, 1)) / 2))

    def bucketed(rows_: DataFrame) -> DataFrame:
        if place is None:
            out = rows_.withColumn("_order", F.xxhash64(*tie)).withColumn("_bucket", F.shiftrightunsigned("_order", 64 - bits))
        else:
            out = rows_.withColumn("_order", F.col(place)).withColumn("_bucket", F.floor(F.col(place) * ((1 << bits) / max(places, 1))).cast("long"))
        for g in group:
            out = out.withColumn(f"_no_{g}", F.col(g).isNull().cast("int"))
            out = out.withColumn(f"_key_{g}", F.coalesce(F.col(g).cast("string"), F.lit("")))
        return out

    keyed = bucketed(df)
    keys = [f"_{kind}_{g}" for g in group for kind in ("no", "key")]
    sums = (keyed if slim is None else bucketed(slim)).groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_order", *tie)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.join(bases, [*keys, "_bucket"])
        .withColumn(into, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop(*keys, "_bucket", "_order", "_base")
    )


def word_count(text: str | F.Column) -> F.Column:
    """Number of words, [^\\x20\\x09-\\x0D]+, of a text; null counts 0."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, WHITE)
    empty = (F.element_at(parts, 1) == "").cast("int") + (
        (F.size(parts) > 1) & (F.element_at(parts, -1) == "")
    ).cast("int")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - empty).cast("long")


def pack_sorted(values: np.ndarray) -> bytes:
    """Compress ascending unsigned 64-bit values: differences, by byte plane, zstd."""
    if not len(values):
        return b""
    delta = np.diff(values, prepend=np.uint64(0))
    return pack_plain(delta)


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_plain(blob), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Compress 64-bit values by byte plane."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_plain(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()
