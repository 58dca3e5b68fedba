from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from veldt.llm.arrow_text import buffer_of
from veldt.llm.filter_audit import distinct_words, failed, filter_audit


def audit(docs, labels):
    """Brute force: every order applied to every document, one after the other."""
    import re

    known = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            good, bad = known.get(doc_id, (False, False))
            known[doc_id] = (good or quality == 1, bad or toxic == 1)
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    rows = []
    for doc_id, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ""
        fails += "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (text in least and (doc_id is None or least[text] < doc_id))
        rows.append((source or "", fails, *known.get(doc_id, (False, False))))
    out = Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_in_all = Counter()
        for order in permutations("ABCDE"):
            for _, fails, _, _ in own:
                gone = [f for f in order if f in fails]
                removed_in_all.update(gone[:1])
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                before = [r for r in own if set(order[: step - 1]) & set(r[1])]
                left = [r for r in left if f not in r[1]]
                out[
                    part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in before), sum(r[1] == f for r in own),
                    sum(r[2] for r in gone), sum(r[3] for r in gone), removed_in_all[f],
                ] += 1
    return out


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (7, None, 1), (7, 0, None), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'s' AS source")


def test_equals_brute_force(spark, sample, odd_documents, labels):
    long = " ".join(f"w{i}" for i in range(250))
    more = [(10, long, "a"), (9, long, "b"), (None, long, "b"), (None, long, "a"), (11, "A " * 300, None), (12, "$" + long, ""), (9, long, "b")]
    extra = spark.createDataFrame(more, "doc_id long, text string, source string")
    real = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for docs, marks in ((odd_documents.select("doc_id", "text", "source").unionByName(extra), labels), (sample, real), (odd_documents, labels.limit(0))):
        rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        want = audit(rows, [tuple(r) for r in marks.select("doc_id", "quality", "toxic").collect()])
        assert Counter(tuple(r[c] for c in COLUMNS) for r in filter_audit(docs, marks).collect()) == want
    assert filter_audit(odd_documents.limit(0), labels).count() == 0


def test_words_end_with_their_document():
    texts = ["ab", "", "cd ", " ef", "x" * 100 + " " + "x" * 100, None, "Ä Ä ä", "\x1c\x1c"]
    import pyarrow as pa

    buffer, edges = buffer_of(pa.array(["skipped", *texts])[1:])
    assert edges.tolist() == np.cumsum([0, *(len((t or "").encode()) for t in texts)]).tolist()
    got = failed(buffer, edges)
    assert got.tolist() == [1, 1, 1, 1, 1, 1, 1, 1]  # two of "x" * 100: 1 of 2 is not under 50 %


def test_distinct_words_survive_equal_hashes():
    import re

    texts = ["a b a c", "a a a", "", "b c d e f b"]
    buffer = np.frombuffer("".join(t + "\n" for t in texts).encode(), np.uint8)
    found, at = [], 0
    for i, t in enumerate(texts):
        found += [(at + m.start(), len(m[0]), i) for m in re.finditer(r"\S+", t)]
        at += len(t) + 1
    starts, sizes, owner = (np.array(x) for x in zip(*found, strict=True))
    assert distinct_words(buffer, starts, sizes, owner, 4).tolist() == [3, 1, 0, 5]
    same = lambda buffer, starts, sizes: np.zeros(len(starts), np.uint64)
    assert distinct_words(buffer, starts, sizes, owner, 4, hashes=same).tolist() == [3, 1, 0, 5]


def test_copies_meet_as_least_ids_only(spark, labels):
    """No plan holds the rows of one text in one task: they are reduced before the shuffle, then joined by text and id."""
    rows = [(i, "one text", "s") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16)
    got = {(r.filter_order, r.step): r for r in filter_audit(docs, labels).collect()}
    assert got["EABCD", 1].removed == 2999 and got["EABCD", 2].removed == 1 and got["ABCDE", 5].redundant == 2999
