import re

from veldt.llm.quality import kept_documents, quality
from veldt.llm.urls import url_filter


def measures(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


def test_measures_equal_brute_force(spark, sample, odd_documents):
    for df in (sample, odd_documents):
        docs = df.select("doc_id", "text").collect()
        rows = quality(df).collect()
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
        assert got == sorted(((r.doc_id is None, r.doc_id or 0), *measures(r.text)) for r in docs)
        assert not any(r.kept and r.base_failed for r in rows)
    assert quality(odd_documents.limit(0)).count() == 0


def test_lines_are_judged_and_removed(spark):
    good = "\n".join(" ".join(f"word{i * 9 + j}" for j in range(9)) + "." for i in range(12))
    bar = "home | about | contact | news | help"
    docs = [(1, good), (2, bar + "\n" + good + "\nAll rights reserved, 2024."), (3, good[:400] + ("\n" + "x | y | z | q") * 300), (4, good + "\n" + good)]
    df = spark.createDataFrame([(i, t, len(t), "s") for i, t in docs], "doc_id long, text string, n_chars long, source string")
    rows = {r.doc_id: r for r in quality(df, clean=True).collect()}
    assert rows[1].kept and rows[1].clean_text == good and rows[1].n_lost_lines == 0
    assert rows[2].kept and rows[2].clean_text == good and rows[2].n_lost_lines == 2
    assert not rows[3].kept
    assert rows[4].clean_text == good
    out = {r.doc_id: r for r in kept_documents(df).collect()}
    assert out[2].text == good and out[2].n_chars == len(good) and out[2].source == "s" and 3 not in out


def test_url_rules_and_reputation(spark):
    rows = [
        (1, "https://a.Example.ORG/es/1?x"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2#top"), (4, "https://b.com/fr/x"), (5, "https://b.com/de/x"),
        (6, "https://b.net/x"), (7, None), (8, "no-scheme/x"), (9, "x://"), (10, "https://example.org"), (11, "https://b.com?q=/fr/"), (11, "https://b.com?q=/fr/"), (None, "https://notorg/x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "'p' AS path")
    got = sorted(((r.page_id or 0), r.host, r.path, r.rule, r.verdict) for r in url_filter(df).collect())
    assert [x[:4] for x in got] == [
        (0, "notorg", "/x", None), (1, "a.example.org", "/es/1", "example.org/es/"), (2, "example.org", "/en/12", "example.org/en/1"), (3, "example.org", "/en/2", "org/"),
        (4, "b.com", "/fr/x", "com/fr/"), (5, "b.com", "/de/x", "com/de/"), (6, "b.net", "/x", None), (7, "", "", None), (8, "", "", None), (9, "", "", None),
        (10, "example.org", "", None), (11, "b.com", "", None), (11, "b.com", "", None),
    ]
    assert {x[4] for x in got if x[0] in (1, 2, 5)} == {"block"} and {x[4] for x in got if x[0] in (3, 4)} == {"allow"}
    assert url_filter(df.limit(0)).count() == 0


def test_bad_hosts_are_blocked_whatever_the_join(spark):
    pages = [(i, f"https://bad.example.net/{i}") for i in range(100)] + [(200 + i, f"https://good.example.net/{i}") for i in range(100)] + [(400, "https://new.example.net/")]
    outcomes = [("bad.example.net", 0)] * 80 + [("good.example.net", 1)] * 80
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "host string, good int")
    for bound in (0, 1000):
        got = {r.page_id: r.verdict for r in url_filter(df, labels, broadcast_bound=bound).collect()}
        assert got == {i: "block" if i < 200 else "allow" for i, _ in pages}


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_equal_measures_are_not_equal_hashes():
    from veldt.llm.quality import LineRules, measured

    for n in (1024, 4096):
        a, b = thue_morse(n)
        m = measured([f"{a}\n{b}".encode(), f"{a} x y {b} x y".encode(), f"{a} x y {a} x y".encode()], LineRules())
        assert m["n_dup_lines"].tolist() == [0, 0, 0]
        assert m["n_repeat_words"].tolist() == [0, 0, 6]


def test_boilerplate_needs_whole_words_and_a_short_line():
    from veldt.llm.quality import LineRules, measured

    def failed(line):
        return bool(len(measured([line.encode()], LineRules())["lines"]))

    assert failed("Click here") and failed("Haga clic, por favor") and failed("\u00a9 Copyright 2024")
    assert not failed("They assign in turn, a design in blue.") and not failed("The catalog in print spread more.")
    assert not failed("An article on copyright, with many more words than any notice at the foot of a page would ever have.")
    assert failed(" ".join(["word"] * 25)) and not failed(" ".join(["word"] * 25) + ".") and not failed(" ".join(["\u6f22"] * 25) + "\u3002")


def test_a_very_long_text_and_url(spark):
    text = " ".join(f"w{i % 9973}" for i in range(400_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = quality(df).first()
    assert got.n_words == 400_000 and got.n_repeat_words == 400_000 and got.base_failed
    page = spark.createDataFrame([(1, "http://x.example.com/fr/" + "p" * 1_000_000)], "page_id long, url string")
    assert url_filter(page).first().rule == "com/fr/"


def test_reputation_is_fitted_and_shrunk(spark):
    """Unlabelled hosts of a domain that is bad throughout are blocked; under co.uk no site answers for another."""
    outcomes = [(f"h{i}.bad.net", 0) for i in range(30) for _ in range(5)] + [(f"h{i}.good.net", 1) for i in range(30) for _ in range(5)]
    outcomes += [("a.co.uk", 0)] * 40 + [("c.co.uk", 1)] * 40
    pages = [(1, "http://new.bad.net/"), (2, "http://new.good.net/"), (3, "http://b.co.uk/"), (4, "http://a.co.uk/x"), (5, "http://w.c.co.uk/x")]
    df, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "host string, good int")
    got = {r.page_id: r for r in url_filter(df, labels).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["block", "allow", "allow", "block", "allow"]
    assert got[1].n_labelled == 0 and got[1].upper_bound < 0.5 < got[3].upper_bound


def test_beta_quantile_is_near_the_true_one(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from veldt.llm.urls import beta_upper

    x = (np.arange(200_000) + 0.5) / 200_000
    for a, b in ((1, 1), (2, 5), (1, 30), (30, 2), (40, 60)):
        density = np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x))
        true = x[np.searchsorted(np.cumsum(density) / density.sum(), 0.95)]
        got = spark.range(1).select(beta_upper(F.lit(float(a)), F.lit(float(b)))).first()[0]
        assert -0.012 < got - true < 0.03, (a, b, got, true)
