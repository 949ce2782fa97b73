"""Instants from timestamps written in many ways, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date (dashed or compact), time to the minute or finer, fraction, offset.
PATTERN = r"^\s*(\d{4}-\d{2}-\d{2}|\d{8})[Tt ]\s*(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?\s*$"


def instant_micros(text: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp text, null where it gives no real calendar date with a time of day to the
    minute or finer. Without an offset it is UTC; digits of a fraction beyond the sixth are dropped."""
    c = F.col(text) if isinstance(text, str) else text
    # one pass of the pattern gives all parts, bound once; the mark in front tells a match from a text left as it was
    marked = F.regexp_replace(c, PATTERN, "\u0001|$1|$2|$3|$4|$5|$6")
    return F.get(F.transform(F.array(F.split(marked, r"\|", 7)), _micros_of_parts), F.lit(0))


def _micros_of_parts(parts: Column) -> Column:
    """Microseconds from (mark, date, hour, minute, second, fraction, offset)."""
    part = lambda k: F.get(parts, F.lit(k))
    digits = F.regexp_replace(part(1), "-", "")
    date = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date")
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    hour, minute, second = number(part(2)), number(part(3)), number(part(4))
    micros = number(F.rpad(F.substring(part(5), 1, 6), 6, "0"))
    zone = F.regexp_replace(part(6), ":", "")
    size = number(F.substring(zone, 2, 2)) * 60 + number(F.substring(zone, 4, 2))
    offset = F.when(zone.startswith("-"), -size).otherwise(size)
    real = (date >= F.lit("0001-01-01").cast("date")) & (hour < 24) & (minute < 60) & (second < 60)
    micros_of = F.unix_date(date).cast("long") * 86_400_000_000 + ((hour * 60 + minute - offset) * 60 + second) * 1_000_000 + micros
    return F.when((part(0) == "\u0001") & real, micros_of)
