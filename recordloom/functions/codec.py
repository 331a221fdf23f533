"""Text codec, value classes and the order-preserving numeric form, as Catalyst expressions.

Everything is a Column built from built-in functions, so it stays inside whole-stage code generation. The few plain
Python twins serve the driver-side parsers of criteria files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of numbers, timestamps (year, day, month, hour, minute, second), canonical arrays and escapes.
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?\z"
TIMESTAMP = r"^[0-9]{4}(0[1-9]|[12][0-9]|3[01])(0[1-9]|1[0-2])([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]\z"
# Possessive, so that long values need no stack.
ARRAY = r'^\[(?:"(?:[^"\\]++|\\["\\])*+"(?:,"(?:[^"\\]++|\\["\\])*+")*+)?+\]\z'
ESCAPE = r"\\\\|\\x[0-9a-fA-F]{2}"
ESCAPE_TOKEN = r"(\\\\|\\x[0-9a-fA-F]{2}|[^\\]+)"
ESCAPES = (("\\", r"\\"), ("\t", r"\x09"), ("\n", r"\x0A"), ("\r", r"\x0D"), ("=", r"\x3D"))
FOOTER_FORMAT = "yyyyddMMHHmmss"
#: The value that deletes a key in a patch.
TOMBSTONE = "\x00"
#: Integer digits that the numeric form can order.
MAX_DIGITS = 9999


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def is_escaped(c: Column) -> Column:
    """Whether every backslash of a text starts a valid escape."""
    return ~F.regexp_replace(c, ESCAPE, "").contains("\\")


def unescape(c: Column) -> Column:
    """The plain text of a valid escaped one; null for others."""

    def plain(token: Column) -> Column:
        byte = F.char(F.conv(F.substring(token, 3, 2), 16, 10).cast("int"))
        return F.when(token == "\\\\", F.lit("\\")).when(token.startswith("\\x"), byte).otherwise(token)

    tokens = F.regexp_extract_all(c, F.lit(ESCAPE_TOKEN), F.lit(1))
    return F.when(~c.contains("\\"), c).when(is_escaped(c), F.array_join(F.transform(tokens, plain), ""))


def unescaped(text: str) -> str | None:
    """Python twin of unescape."""
    if not re.fullmatch(r"(?:[^\\]|\\\\|\\x[0-9a-fA-F]{2})*", text, re.DOTALL):
        return None
    return re.sub(r"\\\\|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)) if m[1] else "\\", text)


def is_array(c: Column) -> Column:
    return c.startswith("[") & c.endswith("]") & (F.length(c) >= 2)


def encode_array(items: Column) -> Column:
    quoted = F.transform(items, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]"))


def decode_array(c: Column) -> Column:
    """Elements of a canonical array; null for other texts."""
    return F.when(c.rlike(ARRAY), F.from_json(c, "array<string>", {"allowUnquotedControlChars": "true"}))


def elements(c: Column) -> Column:
    """Elements of an array-shaped value, a scalar as its one element; a malformed array raises."""
    bad = F.raise_error(F.concat(F.lit("malformed array: "), c)).cast("array<string>")
    return F.when(is_array(c), F.coalesce(decode_array(c), bad)).when(c.isNotNull(), F.array(c))


def classify(c: Column) -> Column:
    """array, timestamp, boolean, number or string, in this precedence. Patterns are tried on what a digit or sign begins."""
    digital = F.when(c.rlike(TIMESTAMP), "timestamp").when(c.rlike(NUMBER), "number").otherwise("string")
    return F.when(is_array(c), "array").when(c.isin("true", "false"), "boolean").when(numeric_start(c), digital).when(c.isNotNull(), "string")


def numeric_start(c: Column) -> Column:
    """Whether the first character is a digit or a minus sign."""
    first = F.ascii(c)
    return first.between(48, 57) | (first == 45)


def norm(c: Column) -> Column:
    """A text whose byte order is the numeric order of number-shaped values, equal for equal numbers; null for others."""
    body = F.ltrim(c, F.lit("-"))
    whole = F.substring_index(body, ".", 1)
    fraction = F.when(body.contains("."), F.rtrim(F.substring_index(body, ".", -1), F.lit("0"))).otherwise(F.lit(""))
    size = F.concat(F.lpad(F.length(whole).cast("string"), 4, "0"), F.lit("_"), whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")))
    negative = c.startswith("-") & ~((whole == "0") & (fraction == ""))
    below = F.concat(F.lit("N"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))
    return F.when(numeric_start(c) & c.rlike(NUMBER) & (F.length(whole) <= MAX_DIGITS), F.when(negative, below).otherwise(F.concat(F.lit("P"), size)))


def norm_of(text: str) -> str | None:
    """Python twin of norm, for the arguments of predicates."""
    m = re.fullmatch(r"(-?)(0|[1-9][0-9]*)(?:\.([0-9]+))?", text, re.ASCII)
    if not m or len(m[2]) > MAX_DIGITS:
        return None
    fraction = (m[3] or "").rstrip("0")
    size = f"{len(m[2]):04d}_{m[2]}" + (f".{fraction}" if fraction else "")
    if m[1] and (m[2] != "0" or fraction):
        return "N" + size.translate(str.maketrans("0123456789", "9876543210")) + "~"
    return "P" + size


def json_string(c: Column) -> Column:
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    coded_ = c
    for plain, coded in [("\\", "\\\\"), ('"', '\\"')] + [(chr(n), short.get(n, f"\\u{n:04x}")) for n in (9, 10, 13)]:
        coded_ = F.replace(coded_, F.lit(plain), F.lit(coded))
    rare = coded_
    for n in (n for n in range(32) if n not in (9, 10, 13)):
        rare = F.replace(rare, F.lit(chr(n)), F.lit(short.get(n, f"\\u{n:04x}")))
    special = F.when(c.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), rare).when(c.rlike(r'["\\\x09\x0A\x0D]'), coded_).otherwise(c)
    return F.concat(F.lit('"'), special, F.lit('"'))


def json_value(c: Column) -> Column:
    """Numbers and booleans verbatim, arrays as arrays of strings, all else quoted."""
    items = F.concat(F.lit("["), F.array_join(F.transform(elements(c), json_string), ","), F.lit("]"))
    bare = c.isin("true", "false") | (numeric_start(c) & c.rlike(NUMBER) & ~c.rlike(TIMESTAMP))
    return F.when(is_array(c), items).when(bare, c).otherwise(json_string(c))


def footer(at: Column) -> Column:
    return F.date_format(at, FOOTER_FORMAT)
