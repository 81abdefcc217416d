"""UTC timestamps with nanoseconds as strings, ordered by a fixed-width key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed


def valid(ts: Column) -> Column:
    return F.coalesce(ts.rlike(fixed.TIMESTAMP), F.lit(False))


def key(ts: Column) -> Column:
    """Orders valid timestamps; null for others. Seconds and nine fraction digits, so strings compare as times do."""
    return F.when(valid(ts), F.concat(F.substring(ts, 1, 19), F.lit("."), F.rpad(F.regexp_extract(ts, r"\.([0-9]+)Z\z", 1), 9, "0")))


def seconds(k: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(k, 1, 19), F.lit("Z"))))


def lasts(start: Column, end: Column, days: Column) -> Column:
    """The time between two keys is a number of days, to the nanosecond."""
    return (seconds(end) - seconds(start) == days * 86400) & (F.substring(start, 20, 10) == F.substring(end, 20, 10))


def month_bounds(year: Column, month: Column) -> tuple[Column, Column]:
    """Keys of a month's begin and of the next one's, from texts of digits."""
    y, m = year.cast("int"), month.cast("int")
    start = F.concat(year, F.lit("-"), month, F.lit("-01T00:00:00.000000000"))
    following = F.when(m == 12, F.concat(F.lpad((y + 1).cast("string"), 4, "0"), F.lit("-01"))).otherwise(F.concat(year, F.lit("-"), F.lpad((m + 1).cast("string"), 2, "0")))
    return start, F.concat(following, F.lit("-01T00:00:00.000000000"))


def window(mode: Column, start: Column, end: Column) -> Column:
    """struct(mode, start, end) with keys, null if a part is invalid."""
    good = mode.isin(list(fixed.MODE_DAYS)) & valid(start) & valid(end)
    return F.when(F.coalesce(good, F.lit(False)), F.struct(mode.alias("mode"), key(start).alias("start"), key(end).alias("end")))
