from veldt.llm.exchange import blocked, pieces
from veldt.llm.suffix_dedup import BIN_BYTES, BLOCK_BYTES, BUCKET_BYTES, without_repeated_bytes

from .test_suffix_dedup import brute


def test_blobs_grow_as_the_table():
    """Every block writes to every bucket and bin: as of fixed sizes there were 144 times as many for 12 times the table."""
    for size in (BUCKET_BYTES, BIN_BYTES):
        blobs = [pieces(n, BLOCK_BYTES) * pieces(n, size) for n in (1 << 30, 12 << 30, 144 << 30)]
        assert blobs[1] < 12.5 * blobs[0] and blobs[2] < 12.5 * blobs[1]
    assert pieces(1 << 29, BLOCK_BYTES) == 128  # small tables keep their sizes


def test_grown_blocks_keep_results(spark, monkeypatch):
    monkeypatch.setattr("veldt.llm.exchange.GROWS_FROM", 100)
    rows = [(i, f"{'one passage that many documents share, word for word ' * (i % 3)}and number {i * 7919} of its own, {'x' * (i % 60)}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert blocked(docs, 20, 20)[2] < sum(len(t) for _, t in rows) / 20 / 10
    got = without_repeated_bytes(docs, block_bytes=20, bucket_bytes=20, bin_bytes=20)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == brute(rows)
