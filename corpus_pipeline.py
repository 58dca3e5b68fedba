"""A training-corpus pipeline: clean, drop near duplicates, redact secrets, mix sources, pack.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all that its predecessor
kept. run() writes every stage but the last as Parquet in the shared folder and reads it again, so a
lost executor never sets back more than a stage; what a later stage has replaced is deleted.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veldt.llm.common import shared_folder
from veldt.llm.mixing import mixed_documents
from veldt.llm.packing import in_file_order, pack
from veldt.llm.quality import kept_documents
from veldt.llm.secrets import redacted
from veldt.llm.simhash import representatives


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failed lines."""
    return kept_documents(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: words in shingles of five, a similarity of 0.8 or more."""
    return representatives(docs, shingle=5)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in training order."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens, numbered in training order.

    The mixing stage writes its documents in training order; a copy's place in it is `place`. Documents that
    no file holds have no order, and no such column.
    """
    ordered = in_file_order(docs)
    path = public_tokenizers.path("word_bpe_49k.json")
    return pack(docs, path) if ordered is None else pack(ordered, path, place="place")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints and tokens are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
