"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when cells are cut.
WHITESPACE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WHITESPACE = "".join(map(chr, WHITESPACE_POINTS))
WHITESPACE_RUN = "[" + WHITESPACE + "]+"

MISSING = "N/A"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of every kind from both ends.

    Padding is nearly always plain spaces, which the first trim takes off fast.
    """
    return F.btrim(F.trim(col(c)), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike("[^" + WHITESPACE + "]")


def tokens(c: Column | str) -> Column:
    """Words between runs of white space; an empty array for a blank line."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WHITESPACE_RUN))


def drop_bad_bytes(c: Column | str) -> Column:
    """Valid UTF-8 only; bytes that are not are left out."""
    return F.replace(F.make_valid_utf8(col(c)), F.lit("\ufffd"), F.lit(""))


def safe_name(c: Column | str) -> Column:
    """Characters outside letters, digits, underscore and hyphen become a hyphen."""
    return F.regexp_replace(col(c), "[^A-Za-z0-9_-]", "-")


def number_text(c: Column | str, places: int = 3) -> Column:
    """A number as short text: at most ``places`` decimals, no trailing zeros."""
    fixed = col(c).cast(f"decimal(38,{places})").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def shown(c: Column | str) -> Column:
    """Text of a value, or the placeholder when it is missing."""
    return F.coalesce(col(c).cast("string"), F.lit(MISSING))


def shown_number(c: Column | str, places: int = 3) -> Column:
    return F.coalesce(number_text(c, places), F.lit(MISSING))


def cut(c: Column | str, limit: int, marker: str) -> Column:
    """The first ``limit`` characters and a marker, or the text itself if shorter."""
    text = col(c)
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(marker))).otherwise(text)


def lines(*parts: Column | str) -> Column:
    """Parts on separate lines; plain strings are literals, null parts are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def says(*parts: Column | str) -> Column:
    """Parts run together; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
