"""Blocks of documents that ask each other questions by key, without moving texts twice.

Documents are dealt to blocks by a hash of their id; blocks are a few megabytes and grow with the root
of the table. A block sends one compressed blob of sorted keys to each bucket of the key space; a bucket
answers each block with the keys that matter to it; the block, recomputed from the same documents, acts
on the answers. Within a block every key is sent once, so a key that a third of all documents holds costs
one entry a block.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import unpack_sorted

#: bits of a truncated key; a chance collision only makes more candidates
KEY_BITS = 46
#: stands for a null id in comparisons: after all others; that a row has no id is carried by `no_id`
NO_ID = 2**63 - 1
#: bytes of text up to which blocks and buckets have the size asked for
GROWS_FROM = 1 << 30


def growth(total: int) -> float:
    """Factor on the sizes of blocks and buckets for a table of `total` bytes.

    Each block writes to each bucket, so that of fixed sizes there are blobs as the square of the table, and ever smaller
    ones. Both sizes grow with the root of the table: blobs keep their size, and are as many as the table has bytes.
    """
    return max(1.0, math.sqrt(total / GROWS_FROM))


def pieces(total: int, size: int) -> int:
    """Number of blocks, buckets or bins of the size asked for, grown as above."""
    return max(24, math.ceil(total / (size * growth(total))))


def blocked(docs: DataFrame, block_bytes: int, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """(block, doc_id, no_id, text as bytes), the bytes of all texts, the number of buckets."""
    plain = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = pieces(total, block_bytes)
    # rows without an id are spread by their texts
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("no_id"), F.col("text"))), F.lit(blocks)).cast("int")
    rows = plain.withColumn("block", block).repartition(blocks, "block")
    return rows.select("block", "doc_id", "no_id", "text"), total, pieces(total, bucket_bytes)


def with_nulls(df: DataFrame) -> DataFrame:
    """Give rows without an id their null back."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def in_order(pdf: pd.DataFrame) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids and texts of a block, by id, and which rows have none; rows of one id in the order of their texts."""
    ids = pdf["doc_id"].to_numpy()
    texts = pdf["text"].to_list()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])) if len(set(ids.tolist())) < len(ids) else np.argsort(ids)
    return ids[order], [texts[i] for i in order], pdf["no_id"].to_numpy()[order]


def bucket_edges(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's keys begin in an ascending array; buckets + 1 places."""
    width = -(-(1 << bits) // buckets)
    limits = np.array([min(i * width, (1 << bits) - 1) for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, limits), len(keys))


def answers(pdf: pd.DataFrame, column: str = "keys") -> np.ndarray:
    """All keys that were answered to a block, ascending."""
    parts = [unpack_sorted(b) for b in pdf[column]]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array `of`."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.searchsorted(of, values)
    at[at == len(of)] = 0
    return of[at] == values
