import random
import re
from itertools import combinations

import numpy as np
import xxhash

from veldt.llm.simhash import RADIUS, components, linked, links, majority, masks, near_copies, near_duplicates, reached, representatives, stars


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs):
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= RADIUS:
            root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((i is None, i or 0), f"{fp:016x}", least.get(find(k))) for k, ((i, _), fp) in enumerate(zip(docs, fps, strict=True)))


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.fingerprint, r.component_id) for r in df.collect())


def test_every_pair_within_the_radius_collides():
    rnd = random.Random(2)
    tables = masks()
    assert len(tables) == 31
    for _ in range(3000):
        x, flips = rnd.getrandbits(64), rnd.sample(range(64), rnd.randrange(RADIUS + 1))
        y = x ^ sum(1 << b for b in flips)
        assert any(x & m == y & m for m in tables)


def connected(edges, values):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    return {frozenset(w for w in values if find(w) == find(v)) for v in values}


def test_large_buckets_are_split_without_loss():
    rnd = random.Random(4)
    values = {rnd.getrandbits(12) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(100)}
    pairs = [(a, b) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= RADIUS]
    for bucket in (8, 1000):
        found = linked(np.array(sorted(values), np.uint64), RADIUS, bucket)
        assert len(found) < len(values) and all((a ^ b).bit_count() <= 64 for a, b in found)
        assert connected(found, values) == connected(pairs, values)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 80)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sample_equals_brute_force(spark, sample):
    docs = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    assert rows_of(near_duplicates(sample)) == brute(docs)


def test_odd_documents(spark, odd_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert rows_of(near_duplicates(odd_documents)) == brute(docs)
    assert near_duplicates(odd_documents.limit(0)).count() == 0


def shingles(text, k=5):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def edited(rnd, words, pool, rate):
    return " ".join(rnd.choice(pool) if rnd.random() < rate else w for w in words)


def test_near_copies_at_a_jaccard_similarity_of_four_fifths_are_found(spark):
    """Against brute force over all pairs: nearly all at 0.8 or more are linked, none under 0.6 is, for any length."""
    rnd = random.Random(8)
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "ti") for b in range(400)]
    docs = []
    for _ in range(150):
        words = [rnd.choice(pool) for _ in range(rnd.choice([60, 150, 400, 1200]))]
        docs.append(" ".join(words))
        docs += [edited(rnd, words, pool, rnd.choice([0.003, 0.01, 0.02, 0.12])) for _ in range(2)]
    own = [shingles(t) for t in docs]
    alike = {(i, j): len(own[i] & own[j]) / len(own[i] | own[j]) for k in range(0, 450, 3) for i, j in combinations(range(k, k + 3), 2)}
    root = {r.doc_id: r.root for r in near_copies(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    high = [p for p, x in alike.items() if x >= 0.8]
    assert len(high) > 150 and sum(root[i] == root[j] for i, j in high) >= 0.95 * len(high)
    assert not any(root[i] == root[j] for (i, j), x in alike.items() if x < 0.6)
    assert all(root[i] != root[j] for i, j in combinations(range(0, 450, 3), 2))


def test_one_document_of_each_group_stays(spark, sample):
    groups = {}
    for r in near_copies(sample).collect():
        groups.setdefault(r.root, []).append(r.doc_id)
    kept = representatives(sample)
    assert kept.columns == sample.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))
    assert links(spark.createDataFrame([(1,), (3,), (2**40,)], "fp long")).count() >= 1


def test_rows_without_or_with_shared_ids_are_documents(spark, odd_documents):
    x, y, z = (" ".join(f"{c}{i}" for i in range(80)) for c in "xyz")
    rows = [(3, y), (5, x), (5, y), (None, z), (None, x), (None, z), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS node", "1 AS root")
    kept = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in representatives(df).collect())
    assert kept == sorted([((False, 3), y), ((False, 5), x), ((True, 0), z), ((False, 7), "")])
    ids = [r.doc_id for r in representatives(odd_documents).collect()]
    assert None in ids and 1 in ids and 2 not in ids and len(ids) == len(set(ids))
    assert representatives(odd_documents.limit(0)).count() == 0


def test_majority_counts_beyond_a_byte():
    rnd = np.random.default_rng(3)
    hashes = rnd.integers(0, 2**63, 3000, dtype=np.uint64) | (rnd.integers(0, 2, 3000, dtype=np.uint64) << np.uint64(63))
    sizes = np.array([0, 1, 600, 0, 255, 256, 1888])
    got, at = majority(hashes, sizes), 0
    for n, fp in zip(sizes, got.tolist(), strict=True):
        own = hashes[at : at + n].tolist()
        at += n
        assert fp == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)


def test_reached_connects_what_brute_force_does():
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**63, (5, 4), dtype=np.uint64)
    values = np.repeat(base, 30, 0)
    for i in range(150):
        for b in rnd.integers(0, 256, 30).tolist():
            values[i, b // 64] ^= np.uint64(1 << b % 64)
    pairs = [(i, j) for i, j in combinations(range(150), 2) if int(np.bitwise_count(values[i] ^ values[j]).sum()) <= 46]
    assert connected(reached(values, 46), range(150)) == connected(pairs, range(150))


def test_stars_keep_components():
    rnd = random.Random(6)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    out = [tuple(x) for x in stars(np.array(pairs, np.int64)).tolist()]
    values = {v for p in pairs for v in p}
    assert connected(out, values) == connected(pairs, values) and len(out) < len(values)
    groups = connected(out, values)
    least = {v: min(g) for g in groups for v in g}
    assert all(a == least[b] for a, b in out)
    assert len(stars(np.zeros((0, 2), np.int64))) == 0
