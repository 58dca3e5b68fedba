"""Secret scans with DataFrame functions only: fixed patterns and a randomness test battery.

Base spans are matches of three patterns. The battery looks at every other long token of an encoded
alphabet: it infers the encoding, and tests the characters for uniformity over its alphabet
(chi-squared), for the number of runs in its two halves, and for serial correlation. The three
p-values are combined; a token that the battery does not reject is consistent with random characters.
So is some ordinary text, the more easily the shorter it is. Therefore each token that passes is also
held against a model of text: how much likelier its characters are as random ones than as text is an
e-value, and the e-values of a length class are held to a false-discovery rate over all its tokens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm.common import checkpointed

# Fixed patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: tokens of the battery: characters of encodings, and padding
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

#: significance of the combined battery: this share of random tokens is lost
ALPHA = 0.01
#: false-discovery rate
RATE = 0.01
#: e-values are counted in steps of a power of ten; as 10**60 tokens of a class would be needed for it to matter, none is counted deeper
DEEPEST = 60
#: Share of each letter in text, over a few European languages, per thousand.
LETTERS = {
    "e": 145, "a": 80, "n": 78, "i": 76, "s": 72, "r": 68, "t": 68, "o": 58, "l": 47, "u": 46, "d": 43, "c": 31, "h": 30,
    "m": 27, "p": 24, "g": 19, "b": 15, "f": 14, "v": 13, "z": 9, "y": 9, "w": 9, "k": 9, "q": 5, "x": 3, "j": 3,
}
_LOW = "".join(LETTERS)
_UP, _DIGITS = _LOW.upper(), "0123456789"
#: Encodings, smallest alphabet first: characters, each group with its share of the characters of text written in it.
#: Groups and letters stand from common to rare in text, so that halves differ where text is not random.
ENCODINGS = (
    (("ABCDEF", 0.04), (_DIGITS, 0.96)),  # text that fits these is numbers
    ((_LOW, 1.0),),
    ((_UP, 1.0),),
    ((_LOW, 0.97), ("234567", 0.03)),
    ((_UP, 0.97), ("234567", 0.03)),
    ((_LOW, 0.95), (_DIGITS, 0.05)),
    ((_UP, 0.95), (_DIGITS, 0.05)),
    ((_LOW, 0.92), (_UP, 0.08)),
    ((_LOW, 0.85), (_UP, 0.08), (_DIGITS, 0.07)),
    ((_LOW, 0.81), (_UP, 0.07), (_DIGITS, 0.06), ("/+", 0.06)),
    ((_LOW, 0.81), (_UP, 0.07), (_DIGITS, 0.06), ("-_", 0.06)),
    ((_LOW, 0.79), (_UP, 0.07), (_DIGITS, 0.06), ("-_/+", 0.08)),
)
#: elements that running() adds up one by one
_BLOCK = 64


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, add, zero: Column) -> Column:
    """For each element what `add` makes of all before it, starting from zero; blocks of elements first, so in linear time."""

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, add)

    def of(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int"))
        sums = F.transform(places, lambda b: total(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        bases = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        inner = lambda base, b: let(
            F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)), lambda part: F.transform(part, lambda _, j: add(base, total(F.slice(part, F.lit(1), j))))
        )
        return F.when(F.size(v) > 0, F.flatten(F.transform(bases, inner))).otherwise(F.slice(v, F.lit(1), F.lit(0)))

    return let(values, of)


def spans_of(text: Column, pattern: str, offset: Column | int = 0) -> Column:
    """Matches of a pattern, in order: array of (start, end, value), in code points from `offset`.

    The pieces between the matches and the matches' own lengths add up to the starts.
    """
    offset = offset if isinstance(offset, Column) else F.lit(offset)

    def of(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))
            before = running(steps, lambda a, x: a + x, F.lit(0))
            starts = F.zip_with(before, F.slice(gaps, F.lit(1), F.size(found)), lambda b, g: offset + b + F.length(g))
            return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))

        return let(F.split(text, pattern, -1), placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def encoding(token: Column) -> Column:
    """The smallest alphabet that a token fits, and for each of its characters the log of random over text; padding is left out."""
    out = None
    for groups in ENCODINGS:
        alphabet, scores = "", []
        size = sum(len(chars) for chars, _ in groups)
        for chars, share in groups:
            shares = [LETTERS.get(c.lower(), 1) for c in chars]
            alphabet += chars
            scores += [math.log10(sum(shares) / (size * share * x)) for x in shares]
        pattern = "^[" + "".join("\\-" if c == "-" else c for c in alphabet) + "]+={0,2}$"
        written = F.split(F.lit(",".join(map(repr, scores))), ",").cast("array<double>")  # folded to one constant
        value = F.struct(F.lit(alphabet).alias("alphabet"), written.alias("scores"))
        out = F.when(token.rlike(pattern), value) if out is None else out.when(token.rlike(pattern), value)
    return out


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic of a cubic; within 0.0002."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def battery(token: Column) -> Column:
    """(p_uniform, p_runs, p_serial, p, log_e) of a token; p is Fisher's combination of the three.

    With n characters of an alphabet of k: chi-squared has mean k - 1 and variance
    2 (k - 1) (n - 1) / n, and is tested by the cube root of a gamma variable of these; neighbours lie
    in different halves of the alphabet with probability 1/2, so their number is binomial; the sum of
    products of neighbouring ranks, centred and scaled, has mean 0 and variance n - 1. log_e is the
    decimal logarithm of the token's likelihood as random characters over that as text.
    """
    core = F.regexp_replace(token, "=+$", "")

    def tests(x: Column) -> Column:
        n, k, ranks = x["n"], x["k"], x["ranks"]
        squares = F.aggregate(F.array_distinct(ranks), F.lit(0.0), lambda a, r: a + F.pow(F.size(F.filter(ranks, lambda o: o == r)).cast("double"), F.lit(2.0)))
        chi = k / n * squares - n
        freedom = (k - 1) * n / (n - 1)
        cube = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        pairs = F.zip_with(F.slice(ranks, F.lit(1), F.size(ranks) - 1), F.slice(ranks, F.lit(2), F.size(ranks) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        changes = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + F.when((p["a"] >= k / 2) != (p["b"] >= k / 2), 1.0).otherwise(0.0))
        runs = F.greatest(F.abs(changes - (n - 1) / 2) - 0.5, F.lit(0.0)) / F.sqrt((n - 1) / 4)
        middle = (k - 1) / 2
        products = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle))
        serial = F.abs(products) / ((k * k - 1) / 12) / F.sqrt(n - 1)
        log_e = F.aggregate(ranks, F.lit(0.0), lambda s, r: s + F.get(x["scores"], r.cast("int")))
        ps = F.struct(normal_tail(cube).alias("u"), (2 * normal_tail(runs)).alias("r"), (2 * normal_tail(serial)).alias("s"), log_e.alias("e"))
        return let(ps, combined)

    def combined(p: Column) -> Column:
        parts = [F.greatest(F.least(p[name], F.lit(1.0)), F.lit(1e-12)) for name in "urs"]
        half = -(F.log(parts[0]) + F.log(parts[1]) + F.log(parts[2]))
        fisher = F.exp(-half) * (1 + half + half * half / 2)
        return F.struct(p["u"].alias("p_uniform"), p["r"].alias("p_runs"), p["s"].alias("p_serial"), fisher.alias("p"), p["e"].alias("log_e"))

    def prepared(e: Column) -> Column:
        ranks = F.transform(F.filter(F.split(core, ""), lambda c: c != ""), lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))
        return F.struct(F.length(core).cast("double").alias("n"), F.length(e["alphabet"]).cast("double").alias("k"), ranks.alias("ranks"), e["scores"].alias("scores"))

    return let(encoding(token), lambda e: let(prepared(e), tests))


def length_class(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


def depths_needed(tokens: DataFrame, rate: float = RATE) -> DataFrame:
    """Per length class, the least depth at which the false-discovery rate holds; at most 31 rows.

    tokens: class, depth (whole powers of ten of the e-value; -1 where the battery rejects). The
    procedure for e-values: tokens at least d deep are discoveries if 10**d is at least the number of
    all tokens of the class over `rate` times that of the discoveries. It holds whatever the
    dependence of the tokens, copies among them.
    """
    counts = tokens.groupBy("class", "depth").agg(F.count("*").alias("n"))
    deeper = Window.partitionBy("class").orderBy(F.col("depth").desc())
    ranked = counts.withColumn("_found", F.sum("n").over(deeper)).withColumn("_all", F.sum("n").over(Window.partitionBy("class")))
    holds = (F.col("depth") >= 0) & (F.col("_all") * F.pow(F.lit(10.0), -F.col("depth")) <= rate * F.col("_found"))
    return ranked.where(holds).groupBy("class").agg(F.min("depth").alias("needed"))


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _scanned(docs: DataFrame) -> DataFrame:
    """docs with _base, the base spans as (start, kind, end), and _tokens: (start, end, class, depth) of tokens clear of them.

    Tokens are looked for between assignments, so that one in an assignment, long or short, or one
    that ends where an assignment begins, is left to it; one that holds another base span is left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def spans(pattern: str, may: Column) -> Column:
        return F.when(may, spans_of(text, pattern)).otherwise(none)

    df = docs.withColumn("_assign", spans(ASSIGN, (text.contains("=") | text.contains(":")) & named))
    df = df.withColumn("_access", spans(ACCESS, text.contains("AKIA"))).withColumn("_hex", spans(HEX, text.rlike(HEX)))

    def plain(column: str, kind: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    long_value = F.filter("_assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE)
    base = F.array_sort(F.concat(let(long_value, lambda a: plain(a, 0)), plain("_access", 1), plain("_hex", 2)))

    def measured(t: Column) -> Column:
        depth = let(battery(t["value"]), lambda b: F.when(b["p"] >= ALPHA, F.greatest(F.least(F.floor(b["log_e"]), F.lit(DEEPEST)), F.lit(0))).otherwise(-1))
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), length_class(F.length(t["value"])).alias("class"), depth.cast("int").alias("depth"))

    def between(ends: Column) -> Column:
        def tokens(gap: Column, i: Column) -> Column:
            begin = F.get(ends, i)
            found = spans_of(gap, TOKEN, begin)
            clear = lambda t: ~t["value"].rlike(f"{ACCESS}|{HEX}") & ((i == F.size(ends) - 1) | (t["end"] < begin + F.length(gap)))
            return F.transform(F.filter(found, clear), measured)

        gaps = F.when(F.size("_assign") > 0, F.split(text, ASSIGN, -1)).otherwise(F.array(text))
        return F.flatten(F.transform(gaps, tokens))

    ends = F.concat(F.array(F.lit(0)), F.transform("_assign", lambda s: s["end"]))
    no_tokens = F.array().cast("array<struct<start:int,end:int,class:int,depth:int>>")
    tokens = F.when(text.rlike(TOKEN), let(ends, between)).otherwise(no_tokens)
    return df.withColumn("_base", base.cast(_SPAN)).withColumn("_tokens", tokens).drop("_assign", "_access", "_hex")


def _with_spans(scanned: DataFrame, tokens: DataFrame, rate: float) -> DataFrame:
    """scanned with _spans: its base spans and the tokens that the rates allow, found over `tokens`."""
    needed = depths_needed(tokens.select(F.explode("_tokens").alias("t")).select("t.class", "t.depth"), rate)
    table = needed.agg(F.map_from_entries(F.collect_list(F.struct("class", "needed"))).alias("_needed"))  # one row of at most 31 entries
    joined = scanned.withColumn("_one", F.lit(1)).join(F.broadcast(table.withColumn("_one", F.lit(1))), "_one").drop("_one")
    found = F.filter("_tokens", lambda t: t["depth"] >= F.coalesce(F.try_element_at("_needed", t["class"]), F.lit(DEEPEST + 1)))
    spans = F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return joined.withColumn("_spans", F.array_sort(F.concat("_base", spans.cast(_SPAN)))).drop("_needed")


def _text_of(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _number(kind: str) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Secret spans of every document.

    docs: doc_id, text; other columns are ignored. Returns doc_id, n_assign, n_access, n_hex (base
    spans), base_sha256, spans and n_random. A span is kind:start:end in code points, end exclusive,
    in order of start, then kind. A null text counts as empty: no spans, the digest of nothing.
    Repeated rows get a row each; an empty table gives no rows. Texts are scanned once, in time linear
    in their matches; the spans and measured tokens, not the texts, are written to the shared
    checkpoint folder.
    """
    scanned = checkpointed(_scanned(docs.select("doc_id", "text")).drop("text"))
    out = _with_spans(scanned, scanned, rate)
    return out.select(
        "doc_id", _number("assign").alias("n_assign"), _number("access").alias("n_access"), _number("hex").alias("n_hex"),
        F.sha2(_text_of("_base"), 256).alias("base_sha256"), _text_of("_spans").alias("spans"),
        (F.size("_spans") - F.size("_base")).cast("long").alias("n_random"),
    )


def redacted(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span, or run of overlapping spans, replaced by a mark.

    Same columns as docs; n_chars is counted anew. Texts are scanned twice, not written in between.
    """
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"own{i}") for i, c in enumerate(names)])
    scanned = _scanned(inner)
    out = _with_spans(scanned, scanned, rate)
    text = F.col("text")

    def cut(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])

        def joined(ahead: Column) -> Column:
            pieces = F.zip_with(spans, ahead, lambda s, a: F.when(s["start"] < a, "").otherwise(F.concat(F.substring(text, a + 1, s["start"] - a), F.lit(mark))))
            return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

        return let(running(ends, lambda a, b: F.greatest(a, b), F.lit(0)), joined)

    changed = F.when(F.size("_spans") == 0, text).otherwise(let(F.col("_spans"), cut))
    columns = []
    for i, c in enumerate(names):
        if c == "text":
            columns.append(F.col("_new").alias(c))
        elif c == "n_chars":
            columns.append(F.coalesce(F.length("_new"), F.lit(0)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"own{i}").alias(c))
    return out.withColumn("_new", changed).select(*columns)
