import hashlib
import random

from veldt.llm.substring import without_repeats


def brute(rows, w):
    first = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for r, (i, ws) in enumerate(docs):
        for s in range(len(ws) - w + 1):
            first.setdefault(tuple(ws[s : s + w]), []).append((i, r, s))
    out = []
    for r, (i, ws) in enumerate(docs):
        gone = [False] * len(ws)
        for s in range(len(ws) - w + 1):
            if any(j < i or (q == r and p < s) for j, q, p in first[tuple(ws[s : s + w])]):
                gone[s : s + w] = [True] * w
        left = b" ".join(x for x, g in zip(ws, gone, strict=True) if not g)
        out.append((i, len(ws), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passages(n=60, seed=3):
    rnd = random.Random(seed)
    pool = [[rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randrange(3, 70))] for _ in range(20)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(pool)
            a = rnd.randrange(len(p))
            words += p[a:] if rnd.random() < 0.5 else p
            words += [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(4))]
        rows.append((i, " ".join(words)))
    return rows


def test_equals_brute_force_on_planted_passages(spark):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = without_repeats(df, with_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows, 20)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_equals_brute_force_on_sample(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    got = without_repeats(sample).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 20)


def test_odd_documents(spark, odd_documents):
    rows = [(2**63 if r.doc_id is None else r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    got = without_repeats(odd_documents).collect()
    assert sorted((2**63 if r[0] is None else r[0], *r[1:]) for r in got) == brute(rows, 20)
    assert without_repeats(odd_documents.limit(0)).count() == 0


def test_complementary_words_and_sequences_are_different(spark):
    """Thue-Morse words and their complements, which polynomial hashes confuse, as words and as sequences of words."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    flip = word.translate(str.maketrans("ab", "ba"))
    plain = " ".join(f"x{i}" for i in range(19))
    rows = [(1, f"{plain} {word}"), (2, f"{plain} {flip}"), (3, " ".join(word[:64])), (4, " ".join(flip[:64])), (5, f"{plain} {word[:1024]}"), (6, f"{plain} {flip[:1024]}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(df).collect()) == brute(rows, 20)


def test_the_largest_id_is_an_id(spark):
    from veldt.llm.substring import without_repeats
    from veldt.llm.suffix_dedup import without_repeated_bytes

    words = " ".join(f"w{i}" for i in range(40))
    rows = [(2**63 - 1, words), (None, words), (None, "other"), (-(2**63), "short"), (5, words), (2**63 - 1, "a" + words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (without_repeats, without_repeated_bytes):
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_removed > 0) for r in f(df).collect())
        assert got == sorted([((False, 2**63 - 1), True), ((True, 0), True), ((True, 0), False), ((False, -(2**63)), False), ((False, 5), False), ((False, 2**63 - 1), True)])
