"""The registered queries of this subpackage: thin wrappers that give the operators their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veldt.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.ann import neighbours

    return neighbours(_table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.suffix_dedup import without_repeated_bytes

    return without_repeated_bytes(_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.secrets import secrets

    return secrets(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.urls import url_filter

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select(
        "page_id", "host", "path", "rule", "verdict", "n_labelled",
        F.round("good_rate", 9).alias("good_rate"), F.round("upper_bound", 9).alias("upper_bound"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.substring import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veldt.llm.bpe_automaton import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldt.llm.vector_codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity,
        op3_nearest_neighbours,
        op4_suffix_dedup,
        op5_secret_scans,
        op6_mixing,
        op7_simhash,
        op8_quality_rules,
        op9_url_filter,
        op10_substring_dedup,
        op11_filter_audit,
        op12_bpe_automaton,
        op13_vector_codes,
        pipeline,
    )
}


def oracle_sql() -> dict[str, str]:
    from veldt.llm import oracles

    return oracles.oracle_sql()
