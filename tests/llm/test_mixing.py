import math
import re
from collections import defaultdict

from veldt.llm.mixing import mix, mixed_documents


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            free.discard(s)
    return out


def check(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, s in docs:
        by[s] += size(t)
    want = targets(by)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in rows) == sorted((i is None, i or 0, size(t)) for i, t, s in docs)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == by[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= 1
    curriculum(rows, want)


def curriculum(rows, want):
    """By any time t, a source's taken words are the integral of its schedule, within the document being read."""
    names = sorted(want, key=lambda s: (s is None, s or ""))
    for s in names:
        slope = (0.0, 0.5, -0.5)[names.index(s) // 3 % 3]
        copies = []
        for r in rows:
            if r.source == s:
                assert len(r.positions) == -(-r.taken // r.size) if r.size else not r.positions
                assert r.position == (r.positions[0] if r.positions else None) and r.positions == sorted(r.positions)
                copies += [(p, min(r.size, r.taken - i * r.size)) for i, p in enumerate(r.positions)]
        total, done = sum(n for _, n in copies), 0
        for t, n in sorted(copies):
            assert abs(((1 - slope) * t + slope * t * t) * total - done) <= max(1e-6 * total, 1e-3)
            done += n


def test_sample_and_reruns_agree(spark, sample):
    docs = [(r.doc_id, r.text, r.source) for r in sample.collect()]
    rows = mix(sample).collect()
    check(docs, rows)
    again = mix(sample.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    read = [r.position for r in rows if r.position is not None]
    assert read == sorted(read) and all(0 <= p <= 1 for p in read)


def test_capped_sources_and_hot_source(spark):
    docs = [(i, "w " * (1 + i % 9), "a" if i % 50 else "tiny") for i in range(3000)] + [(5000 + i, "w " * 400, "m") for i in range(40)]
    check(docs, mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect())


def test_odd_documents(spark, odd_documents):
    docs = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    check(docs, mix(odd_documents).collect())
    assert mix(odd_documents.limit(0)).count() == 0


def test_mixed_documents_hold_what_is_taken(spark, sample):
    took = defaultdict(int)
    for r in mix(sample).collect():
        took[r.source] += r.taken
    out = mixed_documents(sample)
    assert out.columns == sample.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == took


def test_choice_says_nothing_about_the_time_of_reading(spark):
    docs = [(i, "w " * 10, "small" if i % 10 == 0 else "large") for i in range(20_000)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    part = [r for r in rows if r.source == "large" and r.taken]
    assert 0 < len(part) < 15_000  # this source is wanted in part only
    halves = [sum(r.taken for r in part if (r.position < 0.5) == early) for early in (True, False)]
    assert min(halves) > 0.45 * sum(halves)
    assert len({r.doc_id // 2000 for r in part}) == 10


def test_copies_are_far_apart(spark):
    docs = [(i, "w " * 10, "rare" if i < 60 else "b") for i in range(3000)]
    rows = mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), cycle=(1, 50)).collect()
    many = [r.positions for r in rows if len(r.positions) > 1]
    assert many and min(b - a for p in many for a, b in zip(p, p[1:])) > 0.05
