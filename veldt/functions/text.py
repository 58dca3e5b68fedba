"""Text expressions: coercion, splitting, classification, escaping, periods, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def text_or_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def number_or_null(c: Column) -> Column:
    return c.try_cast("double")


def is_one(c: Column) -> Column:
    return F.coalesce(c == 1, F.lit(False))


def namespaced(group: Column, name: Column) -> Column:
    return F.concat_ws(":", group, name)


def aliases(c: Column) -> Column:
    """Parts between semicolons, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def evidence_ids(c: Column) -> Column:
    """Parts between any of / 、 , ， ; ；, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(c, "[/、,，;；]"), lambda x: F.trim(x)), lambda x: x != "")


def indicator_or_null(c: Column) -> Column:
    """R01 to R22, else null."""
    return F.when(c.rlike("^R(0[1-9]|1[0-9]|2[0-2])$"), c)


def indicator_kind(c: Column) -> Column:
    return F.when(c.isin("R01", "R02", "R03", "R04"), "narrative").otherwise("weighted")


def not_applicable(status: Column) -> Column:
    return status.startswith("NA")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def first_number(c: Column) -> Column:
    """The first number of a text, thousands commas removed; null without one."""
    return F.nullif(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def csv_safe(c: Column) -> Column:
    """A field a spreadsheet won't run: ' before a leading control character or = + - @."""
    return F.when(c.rlike(r"^[\x00-\x1f\x7f]") | c.rlike(r"^[\x00-\x20\x7f]*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """Quoted field, quotes doubled, made safe first."""
    return F.concat(F.lit('"'), F.replace(csv_safe(text_or_empty(c)), F.lit('"'), F.lit('""')), F.lit('"'))


def html_escaped(c: Column) -> Column:
    out = c
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def http_url(c: Column) -> Column:
    """Null, or an http(s) URL with a host."""
    return c.isNull() | c.rlike(r"^(?i:https?)://[^\s/?#]+")


def searched(fields: list[Column], wanted: str) -> Column:
    """Whether the fields, joined by blanks, hold a text, in any case."""
    return F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(wanted.lower()))


def iso_day(c: Column, otherwise: str) -> Column:
    """The yyyy-mm-dd at the start of a text, else a default."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")), F.lit(otherwise))


# What stands for a folder of somebody's machine, and how such folders look, in order.
PORTABLE = (
    (r"/[Uu]sers/[^/\"'\s]+/(?:[^\"'\r\n]*?/)?geng/", "external-source/"),
    (r"/[Hh]ome/[^/\"'\s]+/(?:[^\"'\r\n]*?/)?geng/", "external-source/"),
    (r"[A-Za-z]:/[Uu]sers/[^/\"'\s]+/(?:[^\"'\r\n]*?/)?", "external-source/"),
    (r"/[Uu]sers/[^/\"'\s]+/", "user-home/"),
    (r"/[Hh]ome/[^/\"'\s]+/", "user-home/"),
)
LOCAL = (r"(?:^|[\"'\s])/Users/", r"(?:^|[\"'\s])/home/", r"(?:^|[\"'\s])[A-Za-z]:\\", r"(?i)file://")


def portable_path(c: Column) -> Column:
    """Paths of somebody's machine with a general name for their folder."""
    plain = F.replace(c, F.lit("\\"), F.lit("/"))
    for pattern, name in PORTABLE:
        plain = F.regexp_replace(plain, pattern, name)
    return plain


def local_path(c: Column) -> Column:
    """Whether a text names a path of somebody's machine."""
    return c.rlike("|".join(f"(?:{p})" for p in LOCAL))


# How periods are written. Groups: year, then month, quarter or half, then day.
DAY_PERIOD = r"^(\d{4})(?:年|-|/|\.)(\d{1,2})(?:月|-|/|\.)(\d{1,2})日?$"
QUARTER_PERIOD = r"(?i)^(\d{4})\s*(?:-?\s*Q([1-4])|年?\s*第?([一二三四1-4])季度)$"
HALF_PERIOD = r"(?i)^(\d{4})\s*(?:-?\s*H([12])|年?\s*(上|下)半年)$"
MONTHS_PERIOD = r"^(\d{4})年?\s*\d{1,2}\s*[—–-]\s*(\d{1,2})月$"
MONTH_PERIOD = r"^(\d{4})(?:年|-|/|\.)(\d{1,2})月?$"
YEAR_PERIOD = r"^(\d{4})(?:年|年度|年业绩)?$"


def period_key(c: Column) -> Column:
    """A number that sorts free-form periods by their end, yyyymmdd; null if a text is none.

    Full dates, quarters, half-years, month ranges, months and years, in ISO or CJK writing. Whatever
    is longer than a day ends on a day 31 of its last month, so it sorts behind that month's days.
    """
    t = F.trim(c)

    def number(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group).try_cast("int")

    def end_of(year: Column, month: Column) -> Column:
        return year * 10000 + month * 100 + 31

    written = F.translate(F.concat(F.regexp_extract(t, QUARTER_PERIOD, 2), F.regexp_extract(t, QUARTER_PERIOD, 3)), "一二三四", "1234")
    half = F.translate(F.concat(F.regexp_extract(t, HALF_PERIOD, 2), F.regexp_extract(t, HALF_PERIOD, 3)), "上下", "12")
    return (
        F.when(t.rlike(DAY_PERIOD), number(DAY_PERIOD, 1) * 10000 + number(DAY_PERIOD, 2) * 100 + number(DAY_PERIOD, 3))
        .when(t.rlike(QUARTER_PERIOD), end_of(number(QUARTER_PERIOD, 1), written.try_cast("int") * 3))
        .when(t.rlike(HALF_PERIOD), end_of(number(HALF_PERIOD, 1), half.try_cast("int") * 6))
        .when(t.rlike(MONTHS_PERIOD), end_of(number(MONTHS_PERIOD, 1), number(MONTHS_PERIOD, 2)))
        .when(t.rlike(MONTH_PERIOD), end_of(number(MONTH_PERIOD, 1), number(MONTH_PERIOD, 2)))
        .when(t.rlike(YEAR_PERIOD), end_of(number(YEAR_PERIOD, 1), F.lit(12)))
    )


def fnv1a(c: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-16 code units of a text, as 8 hex digits; no Python in it."""
    units = F.split(F.hex(F.encode(c, "UTF-16BE")), "(?<=\\G.{4})")
    step = lambda h, u: ((h.bitwiseXOR(F.conv(u, 16, 10).cast("long"))) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))
    folded = F.aggregate(F.filter(units, lambda u: u != ""), F.lit(0x811C9DC5).cast("long"), step)
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def number_text(x: Column, digits: int = 2) -> Column:
    """A number with commas between thousands and at most some digits, rounded half away from zero, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(F.round(x, digits), digits), r"(\.\d*?)0+$", "$1"), r"\.$", "")
