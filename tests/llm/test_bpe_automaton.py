import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veldt.llm.arrow_text import buffer_of
from veldt.llm.bpe_automaton import Automaton, Encoder, automaton_of, clean_cuts, decoded, encoded, letters_of_bytes, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def automaton():
    return automaton_of(PATH)


def tokens(automaton, texts):
    ids, edges = Encoder(automaton)(texts, *buffer_of(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_tokens_equal_the_library(automaton, library):
    random.seed(5)
    pool = list("aab' st  redl\n\t\r1209.,'-–'éüÀ×÷«»€‘’ªº²¼µ 　\u0085\x1c\x1d\x00中文ий̈😀") + ["<|endoftext|>", "'s", "'ll", " the", "ing", "\n\n"]
    texts = ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(random.choice("ab") for _ in range(random.randint(1, 60))) for _ in range(300)]
    texts += [c * n for c in ("a", " ", "-", "é") for n in range(70)]
    texts += ["x" * 5000, "".join(random.choice("abcdefgh") for _ in range(5000)), "it's 'tis ''s x's's I'll'd ' s"]
    texts += ["q" + chr(c) + "1" + chr(c) + " " + chr(c) + chr(c) + "\n" + chr(c) for c in range(0x3100) if c not in range(0xD800, 0xE000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens(automaton, texts) == want
    assert [automaton.decode(ids) for ids in want] == library.decode_batch(want, skip_special_tokens=False) == texts


def test_any_tokens_are_decoded_as_the_library_does(automaton, library):
    random.seed(6)
    some = [[random.randrange(50257) for _ in range(random.randint(0, 12))] for _ in range(2000)]
    some += [[random.randrange(256) for _ in range(8)] for _ in range(500)]
    assert [automaton.decode(ids) for ids in some] == library.decode_batch(some, skip_special_tokens=False)


def small(merges):
    """A vocabulary of all bytes and the tokens of some merges."""
    vocabulary = {c: b for c, b in letters_of_bytes().items()}
    for i, (a, b) in enumerate(merges):
        vocabulary[a + b] = 256 + i
    return vocabulary


def by_merging(text, vocabulary, merges):
    rank = {m: i for i, m in enumerate(merges)}
    parts = list(text)
    while True:
        best = min((rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:] + [""], strict=True)))
        if best[0] == 1 << 30:
            return [vocabulary[p] for p in parts]
        pair, out, i = (parts[best[1]], parts[best[1] + 1]), [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == pair:
                out.append("".join(pair))
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_random_merges_equal_merging_step_by_step():
    random.seed(7)
    for _ in range(60):
        made, merges = list("abc"), []
        for _ in range(random.randint(0, 14)):
            pair = random.choice(made), random.choice(made)
            if "".join(pair) not in made:
                merges.append(pair)
                made.append("".join(pair))
        vocabulary = small(merges)
        automaton = Automaton(vocabulary, merges)
        words = ["".join(random.choice("abc") for _ in range(random.randint(1, 14))) for _ in range(60)]
        data = np.frombuffer("".join(words).encode(), np.uint8)
        sizes = np.array([len(w) for w in words])
        ids, counts = automaton.many(data, np.cumsum(sizes) - sizes, sizes)
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        want = [by_merging(w, vocabulary, merges) for w in words]
        # a merge that no text reaches makes no token; where one is reached all sequences agree
        assert got == want == [automaton.word(w.encode()) for w in words], merges


def test_only_sequences_that_merging_makes_are_accepted():
    merges = [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "a"), ("aa", "ba")]
    vocabulary = small(merges)
    automaton = Automaton(vocabulary, merges)
    names = {i: t for t, i in vocabulary.items() if set(t) <= {"a", "b"}}
    for first in names:
        for second in names:
            lacks = automaton.lacking[automaton.state[first], automaton.kind[second] >> 3] >> (automaton.kind[second] & 7) & 1
            alive = {first, second} <= set(automaton.tokens.tolist())
            assert not alive or bool(lacks) == (by_merging(names[first] + names[second], vocabulary, merges) != [first, second])


def test_clean_cuts_are_those_of_the_pattern(automaton):
    random.seed(8)
    for _ in range(300):
        texts = ["".join(random.choice("ab' st\n\t1.,éÉ×÷«–’") for _ in range(random.randint(0, 30))) for _ in range(5)]
        buffer, edges = buffer_of(pa.array(texts))
        want, at = [], 0
        for t in texts:
            for w in [w for run in automaton.words(t) for w in run]:
                want.append(at)
                at += len(w.encode())
        assert np.flatnonzero(clean_cuts(buffer, edges)).tolist() == want


def test_round_trip_of_tables(spark, sample, odd_documents, library):
    for docs in (sample, odd_documents):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = []
        for doc_id, text in rows:
            ids = library.encode(text, add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert sorted(map(str, map(tuple, round_trip(docs, PATH).collect()))) == sorted(map(str, want))
        got = decoded(encoded(docs, PATH), PATH).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    assert round_trip(odd_documents.limit(0), PATH).count() == 0
    none = spark.createDataFrame([(1, None), (None, [])], "doc_id long, ids array<int>")
    assert {tuple(r) for r in decoded(none, PATH).collect()} == {(1, None), (None, "")}


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        automaton_of(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        automaton_of(str(tmp_path / "t.json"))
