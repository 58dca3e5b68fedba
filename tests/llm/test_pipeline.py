import re

import corpus_pipeline
from veldt.llm.quality import quality
from veldt.llm.simhash import near_copies

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        kept.append(docs)
    first = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in quality(first).where("kept").collect()}
    groups = {}
    for r in near_copies(kept[0], shingle=5).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    assert {r.doc_id for r in kept[1].collect()} == set(map(min, groups.values()))
    assert kept[2].count() == kept[1].count()
    assert not any(re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r.text) for r in kept[2].collect())
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(kept[3]) - words(kept[2])) <= 20
    packed = kept[4].collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept[3].collect()}


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_take_odd_and_empty_tables(spark, odd_documents):
    """Null ids, clashing names, repeated rows, empty tables: every stage but the last keeps the columns it got."""
    good = "\n".join(" ".join(f"w{i * 9 + j}" for j in range(9)) + "." for i in range(20))
    more = spark.createDataFrame([(None, good, "en", None, 5, "z"), (None, good.upper(), None, "a", None, None)], odd_documents.schema)
    for df in (odd_documents.union(more).withColumnRenamed("block", "node"), odd_documents.limit(0)):
        docs, empty = df, df.isEmpty()
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, FOLDER).cache()
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
                docs = out
        assert out.isEmpty() == empty
        if not empty:
            assert {r.doc_id for r in out.collect()} == {None}
    assert None in {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, odd_documents, FOLDER).collect()}
