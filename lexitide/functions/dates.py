"""Date and interval expressions; timestamps carry no zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: As many seconds around 1970 as microseconds fit 64 bits.
SECONDS = (2**63 - 1) // 10**6
MONTHS = "January February March April May June July August September October November December".split()


def from_epoch(seconds: Column) -> Column:
    """Whole epoch seconds, also as numeric strings, to a timestamp in UTC whatever the session's zone; unparsable ones
    and those that no timestamp holds are null."""
    s = seconds.cast("string").try_cast("double").try_cast("long")
    return F.when(s.between(-SECONDS, SECONDS), F.timestamp_add("SECOND", s, F.lit("1970-01-01").cast("timestamp_ntz")))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def days_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("DAY", start, end)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def month(ts: Column) -> Column:
    """The first day of the month, as a date."""
    return F.trunc(ts.cast("date"), "MM")


def month_end(ts: Column) -> Column:
    """The last day of the month, as a date."""
    return F.last_day(ts.cast("date"))


def month_name(ts: Column) -> Column:
    """The English name of the month."""
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))


def month_number(name: Column) -> Column:
    """1 to 12 for an English name or its first three letters, in any case; null for anything else."""
    out = F.lit(None).cast("int")
    for i, m in enumerate(MONTHS, 1):
        out = F.when(F.lower(name).isin(m.lower(), m[:3].lower()), i).otherwise(out)
    return out


def formatted(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, pattern)


def plus_weeks(ts: Column, weeks: int) -> Column:
    return F.timestamp_add("DAY", F.lit(7 * weeks), ts)


def whole_bin(x: Column, size: float) -> Column:
    """int(x / size) + 1, truncating."""
    return (x / F.lit(float(size))).cast("int") + 1
