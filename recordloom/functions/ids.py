"""Twelve-character identifiers: class, time to the second, and an ordinal within it.

Validation, encoding and decoding are Catalyst expressions. Ids sort by bytes, which isn't chronological order; decode
them to sort by time.
"""

from __future__ import annotations

import re
import string
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of each place of an id.
BASE60 = "0123456789abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNPQRSTUVWXYZ"
MONTHS = "abcdefABCDEF"
DAYS = "0123456789abcdefghijkABCDEFGHIJ"
HOURS = "0abcdefghijklABCDEFGHIJK"
BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
VALID = r"^[A-Z]G[0-9a-km-zA-NP-Z][0-9]{2}[a-fA-F][0-9a-kA-J][0a-lA-K][0-9a-km-zA-NP-Z]{2}[0-9a-zA-Z]{2}\z"
#: Ids of a class in one second.
ORDINALS = 62 * 62
EPOCH = "2024-01-01 00:00:00"


def is_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(VALID), F.lit(False))


def valid(text: str) -> bool:
    return re.fullmatch(VALID.removeprefix("^").removesuffix(r"\z"), text) is not None


def digit(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (n + 1).cast("int"), F.lit(1))


def encode(kind: str, at: Column, ordinal: Column) -> Column:
    """Id of a class (a capital letter), a time (TIMESTAMP_NTZ) and an ordinal under ORDINALS."""
    year = F.year(at)
    parts = [F.lit(kind + "G"), digit(BASE60, F.floor(year / 100)), F.lpad((year % 100).cast("string"), 2, "0"), digit(MONTHS, F.month(at) - 1), digit(DAYS, F.day(at) - 1), digit(HOURS, F.hour(at)), digit(BASE60, F.minute(at)), digit(BASE60, F.second(at))]
    return F.concat(*parts, digit(BASE62, F.floor(ordinal / 62)), digit(BASE62, ordinal % 62))


def numbered(kind: str, n: Column) -> Column:
    """Id of a non-negative number: ORDINALS ids a second from EPOCH on. No window or shuffle is needed."""
    seconds = F.floor(n / ORDINALS).cast("long")
    at = F.timestamp_add("SECOND", seconds, F.lit(EPOCH).cast("timestamp_ntz"))
    return encode(kind, at, (n % ORDINALS).cast("long"))


def value(alphabet: str, c: Column, at: int) -> Column:
    """Value of the digit at a place of an id."""
    return F.position(F.substring(c, at, 1), F.lit(alphabet)) - 1


def decode(c: Column) -> Column:
    """Time of a valid id as TIMESTAMP_NTZ; null for invalid ids and impossible dates."""
    year = value(BASE60, c, 3) * 100 + F.substring(c, 4, 2).try_cast("int")
    at = F.try_make_timestamp_ntz(year, value(MONTHS, c, 6) + 1, value(DAYS, c, 7) + 1, value(HOURS, c, 8), value(BASE60, c, 9), value(BASE60, c, 10).cast("decimal(8,6)"))
    return F.when(is_valid(c), at)


def ordinal(c: Column) -> Column:
    return F.when(is_valid(c), value(BASE62, c, 11) * 62 + value(BASE62, c, 12))


#: The plain time stamps A to F: all orders of three groups of digits, each a letter, century, year, and five more digits.
STAMPS = {name: "".join(groups) for name, groups in zip("ABCDEF", permutations((string.digits, string.ascii_lowercase, string.ascii_uppercase)), strict=True)}


def stamp(name: str, at: Column) -> Column:
    """Time stamp of a format (A to F) for a time (TIMESTAMP_NTZ): the format's letter and eight more characters."""
    alphabet, year = STAMPS[name], F.year(at)
    places = [F.floor(year / 100), F.month(at), F.dayofmonth(at), F.hour(at), F.minute(at), F.second(at)]
    century, *rest = [digit(alphabet, p) for p in places]
    return F.concat(F.lit(name), century, F.lpad((year % 100).cast("string"), 2, "0"), *rest)


def stamped(c: Column) -> Column:
    """Time of a stamp of any format as TIMESTAMP_NTZ; null for other texts and impossible dates."""
    out = F.lit(None).cast("timestamp_ntz")
    for name, alphabet in STAMPS.items():
        century, month, day, hour, minute, second = (value(alphabet, c, i) for i in (2, 5, 6, 7, 8, 9))
        at = F.try_make_timestamp_ntz(century * 100 + F.substring(c, 3, 2).try_cast("int"), month, day, hour, minute, second.cast("decimal(8,6)"))
        out = F.when(c.rlike(rf"^{name}[0-9A-Za-z][0-9]{{2}}[0-9A-Za-z]{{5}}\z"), at).otherwise(out)
    return out
