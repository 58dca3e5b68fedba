import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from veldt.llm.packing import Encoder, best_fit, fillings, pack, patterns

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(tokenizer, text):
    return b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(text, add_special_tokens=False).ids)


def test_words_encode_as_whole_texts(sample):
    tokenizer, encode = Tokenizer.from_file(PATH), Encoder(PATH)
    odd = ["", " ", "İstanbul ΣΑΣ Σ ς ǅ Å", "don't we'll I'M", "á éx ́b", "x y z\r\nw\x0b\x0c", "3.14, -5", "<|endoftext|> <|startoftext|>x", "漢字かな 漢.", "..,, ,.", "ﬁne K", "Ωmega. ΑΣ, ßẞ", "a" * 500, "a's't b' 'tis. x*** (y) z-- !!a a!b é.-. Ab,;", "ab́c, K. ſ. İ."]
    for text in odd + [r.text for r in sample.select("text").limit(80).collect()]:
        assert encode([text]) == [plain(tokenizer, text)], text[:60]


def test_small_cache_gives_the_same(sample):
    tokenizer, encode = Tokenizer.from_file(PATH), Encoder(PATH, most=50)
    for r in sample.select("text").limit(20).collect():
        assert encode([r.text, r.text]) == [plain(tokenizer, r.text)] * 2


def test_filling_is_exact_where_one_exists():
    counts = [0] * 101
    for x in (61, 40, 30, 29):
        counts[x] = 1
    largest, last = [0] * 101, 0
    for i in range(1, 101):
        last = i if counts[i] else last
        largest[i] = last
    assert sorted(fillings(counts, largest, 99)[0]) == [29, 30, 40]  # best fit alone would take 61 and 30


def uses_up(found, histogram, capacity):
    left = dict(histogram)
    for times, lengths in found:
        assert times > 0 and sum(lengths) <= capacity and lengths == sorted(lengths, reverse=True)
        for x in lengths:
            left[x] -= times
    assert not any(left.values())
    return sum(t for t, _ in found)


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - x)
    return len(rooms)


def optimum(lengths, capacity):
    """Least number of sequences, by trying every place for every piece."""
    lengths, best = sorted(lengths, reverse=True), plain_best_fit(lengths, capacity)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= lengths[i]:
                left = list(rooms)
                left.remove(r)
                place(i + 1, [*left, r - lengths[i]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def test_never_worse_than_best_fit_and_exact_without_a_node_bound():
    rnd = random.Random(5)
    assert uses_up(patterns(Counter([11, 10, 8, 8, 7, 7, 6, 2]), 20), Counter([11, 10, 8, 8, 7, 7, 6, 2]), 20) == 3
    for case in range(10_000):
        capacity = rnd.choice([10, 20, 50, 100])
        low = rnd.choice([1, capacity // 5])
        lengths = [rnd.randrange(low, capacity + 1 if case % 3 else max(low + 1, capacity // 2)) for _ in range(rnd.randrange(1, 12))]
        h = Counter(lengths)
        fit = uses_up(best_fit(h, capacity), h, capacity)
        assert fit == plain_best_fit(lengths, capacity)
        n = uses_up(patterns(h, capacity, 50), h, capacity)
        assert n <= fit
        if case % 10 == 0:
            exact = uses_up(patterns(h, capacity, None), h, capacity)
            assert exact == optimum(lengths, capacity) and exact <= n


def test_patterns_use_up_every_length_and_fit():
    rnd = random.Random(1)
    histogram = {rnd.randrange(1, 4097): rnd.randrange(1, 40) for _ in range(300)}
    sequences = uses_up(patterns(histogram), histogram, 4096)
    assert sequences <= uses_up(best_fit(histogram), histogram, 4096)
    large = {rnd.randrange(1400, 2731): rnd.randrange(1, 2000) for _ in range(1500)}  # two or one to a sequence
    assert uses_up(patterns(large), large, 4096) <= uses_up(best_fit(large), large, 4096)
    assert patterns({}) == [] and patterns({4096: 10**9, 1: 5}) in ([(10**9, [4096]), (1, [1] * 5)], [(1, [1] * 5), (10**9, [4096])])


def check(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text in docs:
        data = plain(tokenizer, text or "") + b"\1\0\0\0"
        parts = [data[i : i + 4 * 4096] for i in range(0, len(data), 4 * 4096)]
        want[doc_id].append([(i, i * 4096, len(p) // 4, zlib.crc32(p)) for i, p in enumerate(parts)])
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x for one in v for x in one) for k, v in want.items()}
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


def test_sample_is_packed_whole_and_gapless(spark, sample):
    docs = [(r.doc_id, r.text) for r in sample.select("doc_id", "text").collect()]
    rows = pack(sample, PATH).collect()
    sequences = check(rows, docs)
    assert sequences <= sum(r.length for r in rows) / 4096 * 1.02 + 1


def test_odd_documents(spark, odd_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    check(pack(odd_documents, PATH).collect(), docs)
    assert pack(odd_documents.limit(0), PATH).count() == 0


def test_sequences_follow_the_training_order(spark, sample, tmp_path):
    """Rows written in order keep their places; sequences are numbered by the mean place; waste is that of any dealing."""
    from pyspark.sql import functions as F

    from veldt.llm.packing import in_file_order

    path = public_tokenizers.path("word_bpe_49k.json")
    sample.unionByName(sample.where("doc_id % 3 = 0")).orderBy(F.xxhash64("doc_id", "text")).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    placed = in_file_order(docs)
    order = [r.h for r in placed.select("place", F.xxhash64("doc_id", "text").alias("h")).orderBy("place").collect()]
    assert order == sorted(order) and sorted(r.place for r in placed.collect()) == list(range(docs.count()))
    assert in_file_order(spark.createDataFrame([(1, "x")], "doc_id long, text string")) is None
    rows, plain = pack(placed, path, place="place").collect(), pack(docs, path).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in plain)
    assert len({r.sequence_id for r in rows}) == len({r.sequence_id for r in plain}) == max(r.sequence_id for r in rows) + 1
    own = {}
    for r in rows:
        own.setdefault(r.sequence_id, []).append(r)
    means = [sum(r.place for r in own[i]) / len(own[i]) for i in range(len(own))]
    assert means == sorted(means)
    for pieces in own.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len({(r.place, r.piece) for r in rows}) == len(rows)  # copies of a document are told apart
