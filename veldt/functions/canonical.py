"""Canonical JSON of nested columns, and the identifiers of runs that are hashed from it.

The serialiser follows the schema: members in the order of their names, numbers and strings as
ECMAScript writes them. It is one expression of built-in functions, so equal requests have equal
text, and equal identifiers, wherever and in whatever order their columns were put together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.functions.text import fnv1a

#: multiplier and start of the two halves of the double hash (fixed values)
LEFT = (0x01000193, 0x811C9DC5)
RIGHT = (0x85EBCA6B, 0x9E3779B9)

_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(c: Column) -> Column:
    """A text in quotes; only quotes, backslashes and control characters are escaped."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    names = F.create_map(*(F.lit(x) for i in range(0x20) for x in (chr(i), _SHORT.get(chr(i), f"\\u{i:04x}"))))
    escaped = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.try_element_at(names, x), x)), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), escaped).otherwise(plain), F.lit('"'))


def js_number(c: Column) -> Column:
    """A double as ECMAScript prints it: no exponent from 1e-6 up to 1e21, no fraction for whole numbers.

    Null and what is not finite stay null.
    """
    size = F.abs(c)
    text = c.cast("string")
    # the digits are Java's; only their layout changes
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$", "")
    wide = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,16)").cast("string"), r"0+$", ""), r"\.$", "")
    small = F.regexp_replace(text.try_cast("decimal(38,28)").cast("string"), r"0+$", "")
    exponent = F.regexp_extract(text, r"E(-?\d+)$", 1)
    scientific = F.concat(F.when(c < 0, "-").otherwise(""), digits, F.lit("e"), F.when(size >= 1, "+").otherwise(""), exponent)
    return (
        F.when(c.isNull() | F.isnan(c) | (size == float("inf")), F.lit(None).cast("string"))
        .when(c == 0, "0")
        .when((size < 1e21) & (c == F.rint(c)), F.when(size < 1e21, c).cast("decimal(38,0)").cast("string"))
        .when((size >= 1e-6) & (size < 1e-3), small)
        .when((size >= 1e-3) & (size < 1e7), F.regexp_replace(text, r"\.0$", ""))
        .when((size >= 1e7) & (size < 1e21), wide)
        .otherwise(scientific)
    )


def _order(name: str) -> bytes:
    return name.encode("utf-16-be", "surrogatepass")


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """The JSON text of a column of a type, never null: null, NaN and infinities are `null`.

    Structs have all their members, by name in the order of UTF-16 code units; maps likewise by key. Floats
    go by their exact double; decimals keep their digits but for trailing zeros; dates and times are
    texts in ISO form.
    """
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        parts: list[Column] = []
        for i, f in enumerate(sorted(kind.fields, key=lambda f: _order(f.name))):
            parts += [F.lit("," if i else ""), json_string(F.lit(f.name)), F.lit(":"), canonical_json(c.getField(f.name), f.dataType)]
        text = F.concat(F.lit("{"), *parts, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.struct(F.encode(e["key"].cast("string"), "UTF-16BE").alias("o"), F.concat(json_string(e["key"].cast("string")), F.lit(":"), canonical_json(e["value"], kind.valueType)).alias("t"))
        members = F.transform(F.array_sort(F.transform(F.map_entries(c), entry)), lambda e: e["t"])
        text = F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = c.cast("string")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = js_number(c.cast("double"))
    elif isinstance(kind, T.DecimalType):
        text = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, T.IntegralType):
        text = c.cast("string")
    elif isinstance(kind, T.NullType):
        return null
    elif isinstance(kind, T.TimestampType):
        text = json_string(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    elif isinstance(kind, T.StringType | T.DateType):
        text = json_string(c.cast("string"))
    else:
        raise TypeError(f"no JSON for {kind.simpleString()}")
    return F.when(c.isNull(), null).otherwise(F.coalesce(text, null))


def _units(c: Column) -> Column:
    """The UTF-16 code units of a text, as numbers."""
    units = F.filter(F.split(F.hex(F.encode(c, "UTF-16BE")), "(?<=\\G.{4})"), lambda u: u != "")
    return F.transform(units, lambda u: F.conv(u, 16, 10).cast("long"))


def _folded(units: Column, multiplier: int, start: int) -> Column:
    """32-bit hash: exclusive or with the next unit, times the multiplier, modulo 2**32."""

    def step(h: Column, u: Column) -> Column:
        x = h.bitwiseXOR(u)
        high = F.shiftleft((x * (multiplier >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)  # no product leaves 63 bits
        return (high + x * (multiplier & 0xFFFF)).bitwiseAND(F.lit(0xFFFFFFFF))

    return F.aggregate(units, F.lit(start).cast("long"), step)


def double_hash(c: Column) -> Column:
    """Two 32-bit multiplicative hashes of a text, as 16 hex digits."""
    both = F.transform(F.array(_units(c)), lambda u: F.concat(*(F.lpad(F.hex(_folded(u, *half)), 8, "0") for half in (LEFT, RIGHT))))  # units once
    return F.lower(both[0])


def assessment_run_id(text: Column) -> Column:
    """Identifier of a fixed-weight assessment by the canonical text of its request."""
    return F.concat(F.lit("kcr3-"), fnv1a(text))


def technology_run_id(text: Column) -> Column:
    """Identifier of a technology score by the canonical text of its request."""
    return F.concat(F.lit("ktr-"), double_hash(text))


def baseline_run_id(at: Column, company: Column) -> Column:
    """Identifier of a baseline by the time it was made at, in milliseconds to base 36, and its company."""
    return F.concat(F.lit("tqb-"), F.lower(F.conv(F.unix_millis(at), 10, 36)), F.lit("-"), company)
