import itertools
import math
import random
import zlib

import numpy as np

from veldt.llm.toxicity import marginals, toxicity


def test_marginals_equal_enumeration():
    rnd = random.Random(3)
    t = np.array([[0.3, -1.0], [-0.4, 0.8]])
    lengths = [1, 5, 3, 9]
    e = np.array([rnd.uniform(-2, 2) for _ in range(sum(lengths))])
    starts = np.cumsum(lengths) - np.array(lengths)
    got = marginals(e, starts, t)
    for s, n in zip(starts, lengths, strict=True):
        want, z = np.zeros(n), 0.0
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(t[a, b] for a, b in zip((0, *y), y)) + sum(e[s + i] for i in range(n) if y[i]))
            z += w
            want += w * np.array(y)
        assert np.allclose(got[s : s + n], want / z)


def test_segments_do_not_change_long_chains(monkeypatch):
    import veldt.llm.toxicity as module

    e = np.random.default_rng(1).normal(size=1000)
    t = np.array([[0.5, -0.5], [-0.2, 0.6]])
    whole = marginals(e, np.array([0, 400]), t)
    monkeypatch.setattr(module, "SEGMENT", 7)
    assert np.allclose(whole, marginals(e, np.array([0, 400]), t))


def corpus(n=500, seed=6):
    rnd = random.Random(seed)
    common = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    words = [w.replace("w", "") + x for w in common for x in ("ing", "er")]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(30, 90))]
        bad = i % 5 == 1
        if bad:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(["dreckhead", "dreckface", "Scumbag"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_documents_and_offsets(spark):
    rows, labels = corpus()
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(rows)
    truth, texts = dict(labels), dict(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    spans = [(texts[r.doc_id].lower()[s.start : s.end]) for r in held for s in r.spans]
    assert spans and sum(w in ("dreckhead", "dreckface", "scumbag") for w in spans) >= 0.9 * len(spans)


def test_held_out_labels_are_never_used(spark):
    rows, labels = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    out = toxicity(odd_documents, labels).collect()
    assert len(out) == odd_documents.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity(odd_documents.limit(0), labels).count() == 0
    assert toxicity(odd_documents, labels.limit(0)).count() == odd_documents.count()


def test_offsets_are_in_the_text_as_it_is(spark):
    rows, labels = corpus(300)
    rows = [(i, "İİİ ẞ " + t) for i, t in rows]
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    texts = dict(rows)
    words = [texts[r.doc_id][s.start : s.end] for r in out for s in r.spans]
    assert sum(w.lower() in ("dreckhead", "dreckface", "scumbag") for w in words) >= 0.9 * len(words) > 0


def test_long_texts_train_too(spark):
    rows, labels = corpus(200)
    rows = [(i, t + (" thing" * 3000 if y else "")) for (i, t), (_, y) in zip(rows, labels, strict=True)]
    assert all(len(t) > 6000 for (_, t), (_, y) in zip(rows, labels, strict=True) if y)
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert held and sum(r.predicted for r in held) >= 0.9 * len(held)
