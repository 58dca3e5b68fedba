import hashlib
import random
import re

import numpy as np

from veldt.llm.runindex import RunIndex
from veldt.llm.suffix_dedup import without_repeated_bytes

from .test_substring import passages


def brute(rows, w=50):
    least = {}
    docs = [(i, (t or "").encode()) for i, t in rows]
    for i, t in docs:
        for s in range(len(t) - w + 1):
            x = t[s : s + w]
            least[x] = min(i, least.get(x, i))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - w + 1):
            if least[t[s : s + w]] < i:
                gone[s : s + w] = b"\1" * w
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def test_index_finds_longest_matches():
    rnd = random.Random(5)
    strings = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    strings += [strings[3], strings[7] * 2]
    buffer = np.frombuffer(b"|".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    ends = np.cumsum(sizes + 1) - 1
    depth = 6
    labels = np.array([rnd.randrange(100) for _ in strings])
    index = RunIndex(np.append(buffer, np.uint8(0)), ends - sizes, ends, labels, depth)
    patterns = [bytes(rnd.choice(b"abc") for _ in range(25)) for _ in range(30)] + strings
    joined = np.frombuffer(b"".join(patterns), np.uint8)
    p_ends = np.cumsum([len(p) for p in patterns])
    p_starts = p_ends - np.array([len(p) for p in patterns])
    for who, place, row, at, length in index.stream(p_starts, p_ends, joined):
        for w, p, r, a, n in zip(who, place, row, at, length, strict=True):
            rest = patterns[w][p - p_starts[w] :]
            longest = max((k for k in range(min(depth, len(rest)) + 1) if any(rest[:k] in s for s in strings)), default=0)
            assert min(n, depth) == longest
            assert index.text[a : a + longest].tobytes() == rest[:longest]
            if longest == depth:
                want = min(lab for s, lab in zip(strings, labels, strict=True) if rest[:depth] in s)
                assert index.least_label(np.array([r]))[0] == want


def test_equals_brute_force_on_planted_passages(spark):
    rows = passages(80, 11) + [(100, "ab" * 200), (101, "ab" * 90 + "x" * 70), (102, "y" + "x" * 60), (103, "x" * 49), (104, "x" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_repeated_bytes(df, with_text=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_equals_brute_force_on_sample(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in without_repeated_bytes(sample).collect()) == brute(rows)


def test_odd_documents(spark, odd_documents):
    rows = [(2**63 if r.doc_id is None else r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    got = without_repeated_bytes(odd_documents).collect()
    assert sorted((2**63 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows)
    assert without_repeated_bytes(odd_documents.limit(0)).count() == 0
