"""SQL for DuckDB of the training-data queries that SQL can express."""

from __future__ import annotations

from veldt.llm.filter_audit import filter_audit_sql
from veldt.llm.mixing import MOST_REPEATS, SLOPES, WEIGHT_CYCLE
from veldt.llm.quality import OTHER_PUNCTUATION, PUNCTUATION, LineRules
from veldt.llm.urls import LEAST_GOOD, LEAST_STRENGTH, MOST_STRENGTH, RULES, STRENGTH, Z, registered
from veldt.llm.vector_codes import vector_codes_sql

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _d(x: float) -> str:
    return f"CAST('{x}' AS DOUBLE)"


def url_filter_sql() -> str:
    text, verdict = "NULL", "NULL"
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        text = f"CASE WHEN {fits} THEN '{host + path}' ELSE {text} END"
        verdict = f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    name = registered()

    def strength(table: str) -> str:
        ratio = "sum((good - n * m) * (good - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m))"
        fitted = f"CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0 THEN {ratio} END"
        return (
            f"(SELECT CASE WHEN r IS NULL THEN {_d(STRENGTH)} WHEN r <= {_d(1 / (MOST_STRENGTH + 1))} THEN {_d(MOST_STRENGTH)} "
            f"ELSE greatest({_d(LEAST_STRENGTH)}, 1 / r - 1) END AS s FROM (SELECT {fitted} AS r FROM {table} WHERE n > 1))"
        )

    a, b, y = f"greatest(good + s * m, {_d(1)})", f"greatest(n - good + s * (1 - m), {_d(1)})", _d(-Z)
    lam = f"(({y} * {y} - 3) / 6)"
    return rf"""
WITH rest AS (SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, {_LOW.format("regexp_extract(r, '^[^/?#]*')")} AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, {text} AS rule, {verdict} AS ruled FROM parts),
hosts AS (SELECT host, regexp_extract(host, '{name}') AS domain, regexp_extract(host, '{name}', 2) AS suffix, count(ruled) AS n, count(*) FILTER (ruled = 'allow') AS good FROM ruled GROUP BY 1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY 1, 2),
x AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY 1),
r AS (SELECT (sum(good) + {_d(1)}) / (sum(n) + {_d(2)}) AS m FROM x),
x1 AS (SELECT x.*, r.m FROM x, r),
x2 AS (SELECT suffix, (good + s * m) / (n + s) AS m FROM x1, {strength("x1")}),
d1 AS (SELECT d.*, x2.m FROM d JOIN x2 USING (suffix)),
d2 AS (SELECT domain, suffix, (good + s * m) / (n + s) AS m FROM d1, {strength("d1")}),
h1 AS (SELECT hosts.*, d2.m FROM hosts JOIN d2 USING (domain, suffix)),
h2 AS (SELECT host, n, (good + s * m) / (n + s) AS mean, {a} AS a, {b} AS b FROM h1, {strength("h1")}),
q AS (SELECT *, 2 / (1 / (2 * a - 1) + 1 / (2 * b - 1)) AS h FROM h2),
w AS (SELECT *, {y} * sqrt(h + {lam}) / h - (1 / (2 * b - 1) - 1 / (2 * a - 1)) * ({lam} + {_d(5)} / 6 - {_d(2)} / (3 * h)) AS w FROM q),
u AS (SELECT host, n, mean, a / (a + b * exp(2 * w)) AS upper_bound FROM w)
SELECT page_id, ruled.host, path, rule, coalesce(ruled, CASE WHEN upper_bound < {_d(LEAST_GOOD)} THEN 'block' ELSE 'allow' END) AS verdict,
  n AS n_labelled, round(mean, 9) AS good_rate, round(upper_bound, 9) AS upper_bound FROM ruled JOIN u USING (host)"""


def quality_sql(rules: LineRules = LineRules()) -> str:
    edge = r"[^a-z0-9\x{80}-\x{10FFFF}]"
    by_size: dict[int, list[str]] = {}
    for p in rules.phrases:
        by_size.setdefault(len(p.split()), []).append(p)
    phrases = " OR ".join(
        f"(len(ws) <= {n * rules.phrase_share} AND regexp_matches({_LOW.format('line')}, '(^|{edge})({'|'.join(ps)})($|{edge})'))" for n, ps in by_size.items()
    )
    marks = PUNCTUATION.decode() + OTHER_PUNCTUATION
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
three AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
  SELECT doc_id, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM three, range(3) s(j) WHERE n > 1 GROUP BY 1),
chars AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY 1),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t)),
m AS (SELECT doc_id, line, regexp_extract_all(line, '{_WORD}') AS ws, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth FROM l),
f AS (SELECT doc_id, nth > 1 AS dup, length(array_to_string(ws, '')) AS c, len(ws) AS words,
  nth > 1 OR length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) >= {_d(rules.symbols)} * length(line)
  OR (length(regexp_replace(line, '[^|>]', '', 'g')) >= {rules.separators} AND length(regexp_replace(line, '[^|>]', '', 'g')) >= {_d(rules.separator_share)} * len(ws))
  OR (len(ws) >= {rules.bare_words} AND NOT regexp_matches(line, '[{marks}]')) OR {phrases} AS failed FROM m WHERE len(ws) > 0),
lines AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (failed) AS n_lost_lines, coalesce(sum(c) FILTER (failed), 0)::BIGINT AS lost_chars,
  coalesce(sum(words) FILTER (failed), 0)::BIGINT AS lost_words FROM f GROUP BY 1),
a AS (SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_lines, 0) AS n_lost_lines, coalesce(lost_chars, 0) AS lost_chars, coalesce(lost_words, 0) AS lost_words
  FROM t LEFT JOIN chars USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars <= {_d(rules.lost)} * word_chars AND n_words - lost_words >= {rules.least_words} AS kept, n_lost_lines, lost_chars FROM b"""


def mixing_sql(cycle=WEIGHT_CYCLE, cap: float = MOST_REPEATS, slopes=SLOPES) -> str:
    """For tables of up to 2**24 rows, whose buckets of documents have names of three digits."""
    n, k = len(cycle), len(slopes)
    ahead = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY 1),
r AS (SELECT *, {_d(cap)} * source_size AS lim, CAST([{", ".join(map(str, cycle))}][place % {n} + 1] AS DOUBLE) AS weight FROM s),
q AS (SELECT *, lim / weight AS ratio FROM r),
t AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, coalesce(sum(lim) OVER up, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS weight_left
  FROM q WINDOW up AS (ORDER BY ratio, place {ahead})),
l AS (SELECT *, (total - capped) / weight_left AS level FROM t),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
g AS (SELECT source, source_size, least(lim, coalesce(weight * (SELECT level FROM f), lim)) AS target,
  [{", ".join(_d(x) for x in slopes)}][(place // {n}) % {k} + 1] AS slope FROM l),
w AS (SELECT *, CAST(floor(target + {_d(0.5)}) AS BIGINT) AS words FROM g),
h AS (SELECT *, words // greatest(source_size, 1) AS whole, words - (words // greatest(source_size, 1)) * source_size AS rest FROM w),
o AS (SELECT d.*, h.* EXCLUDE (source), md5(concat_ws(':', 'choose', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS choice,
  md5(concat_ws(':', 'read', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(size AS VARCHAR))) AS reading FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
b AS (SELECT *, substr(choice, 1, 3) AS bucket, coalesce(sum(size) OVER (PARTITION BY source ORDER BY choice, doc_id, size {ahead}), 0) AS chosen FROM o),
e AS (SELECT *, least(greatest(rest - chosen, 0), size) AS extra FROM b),
v AS (SELECT *, coalesce(sum(size) OVER z, 0) AS round, coalesce(sum(extra) OVER z, 0) AS last FROM e
  WINDOW z AS (PARTITION BY source ORDER BY md5('bucket:' || bucket), bucket, reading, doc_id, size {ahead})),
u AS (SELECT *, CAST(whole * size + extra AS BIGINT) AS taken, (CASE WHEN whole > 0 THEN round ELSE last END) / CAST(greatest(words, 1) AS DOUBLE) AS u FROM v)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN u
  ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / (2 * slope) END END AS position FROM u"""


SUBSTRING_SQL = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM t WHERE len(ws) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY md5(array_to_string(ws[s : s + 19], ' ')) ORDER BY doc_id, s) AS r FROM starts),
repeated AS (SELECT doc_id, s FROM ranked WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS i FROM repeated, range(20) x(j)),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t),
m AS (SELECT w.doc_id, w.i, word, gone.i IS NOT NULL AS removed FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM m GROUP BY 1)
SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN k USING (doc_id)"""


SUFFIX_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 AS BIGINT))) AS p FROM t),
k AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b, CASE WHEN 2 * p + 100 <= length(h) THEN md5_number(substr(h, 2 * p + 1, 100)) END AS k FROM p),
f AS (SELECT doc_id, p, b, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS hit FROM k),
g AS (SELECT doc_id, p, b, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY p) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT t.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM t LEFT JOIN a USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_suffix_dedup": SUFFIX_SQL,
        "op6_mixing": mixing_sql(),
        "op8_quality_rules": quality_sql(),
        "op9_url_filter": url_filter_sql(),
        "op10_substring_dedup": SUBSTRING_SQL,
        "op11_filter_audit": filter_audit_sql(),
        "op13_vector_codes": vector_codes_sql(),
    }
