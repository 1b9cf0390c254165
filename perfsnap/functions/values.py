"""Numbers and times out of text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perfsnap.functions.text import col, strip

NUMBER = r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?(?i:inf|infinity))$"

# How a dump writes the end of a snapshot.
SNAPSHOT_TIME = "yy/M/d H:m"
FREE_TIMES = (
    "yyyy-M-d H:m:s",
    "yyyy-M-d H:m",
    "yyyy-M-d",
    "yyyy/M/d H:m:s",
    "yyyy/M/d H:m",
    "yyyy/M/d",
    "M/d/yyyy H:m:s",
    "M/d/yyyy H:m",
    "M/d/yyyy",
)


def stripped_number(text: Column) -> Column:
    """DOUBLE out of text without outer white space, or null if it is not wholly a number."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_number(c: Column | str) -> Column:
    """DOUBLE, or null for anything that is not wholly a number."""
    return stripped_number(strip(col(c).cast("string")))


def to_number_or_zero(c: Column | str) -> Column:
    return F.coalesce(to_number(c), F.lit(0.0))


def whole_part(n: Column) -> Column:
    """A number as BIGINT, or null if it has a fraction."""
    return F.when(n == F.rint(n), n.try_cast("bigint"))


def to_whole(c: Column | str) -> Column:
    """BIGINT, or null for fractions and non-numbers."""
    return whole_part(to_number(c))


def to_snapshot_time(c: Column | str) -> Column:
    """Two-digit years 69 to 99 belong to the 1900s; bad text becomes null."""
    t = F.try_to_timestamp(strip(c), F.lit(SNAPSHOT_TIME))
    return F.when(F.year(t) >= 2069, t + F.make_ym_interval(F.lit(-100), F.lit(0))).otherwise(t)


def to_any_time(c: Column | str) -> Column:
    """The dump format first, then common free formats."""
    text = strip(c)
    return F.coalesce(to_snapshot_time(c), *[F.try_to_timestamp(text, F.lit(f)) for f in FREE_TIMES])


def minutes_before(end: Column | str, minutes: Column | str) -> Column:
    zero = F.lit(0)
    return col(end) - F.make_dt_interval(zero, zero, col(minutes).cast("int"), F.lit(0).cast("decimal(18,6)"))
