"""Period keys and time windows; the present moment is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def minute_label(ts: Column, minutes: int) -> Column:
    """HH:MM of the interval within the hour; no date. Intervals under one minute count as one."""
    n = max(minutes, 1)
    return F.format_string("%02d:%02d", F.hour(ts), (F.floor(F.minute(ts) / n) * n).cast("int"))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso_week_key(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def plain_week_key(ts: Column) -> Column:
    """Week of the recurring generator: weeks from the year's first day, starting on Sundays."""
    first = F.dayofweek(F.trunc(ts, "year")) - 1
    week = F.ceil((F.dayofyear(ts) - 1 + first + 1) / 7).cast("string")
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), week)


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parsed(text: Column) -> Column:
    """Instant of an ISO or 'YYYY-MM-DD HH:MM:SS UTC' string; null for others."""
    return F.try_to_timestamp(text)


def at(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def today_so_far(ts: Column, as_of: datetime | str) -> Column:
    return ts.between(F.date_trunc("day", at(as_of)), at(as_of))


def last_week(ts: Column, as_of: datetime | str, whole_days: bool) -> Column:
    """Since six days ago; whole_days: from that day's midnight."""
    start = at(as_of) - F.expr("interval 6 days")
    return ts.between(F.date_trunc("day", start) if whole_days else start, at(as_of))


def this_month(ts: Column, as_of: datetime | str, whole: bool) -> Column:
    """From the month's start until now; whole: until the month's end."""
    start = F.date_trunc("month", at(as_of))
    return (ts >= start) & ((ts < start + F.expr("interval 1 month")) if whole else (ts <= at(as_of)))


def trend_start(as_of: datetime | str, span: str) -> Column:
    spans = {"6months": "interval 6 months", "12weeks": "interval 84 days"}
    if span not in spans:
        raise ValueError(f"range must be one of {sorted(spans)}")
    return at(as_of) - F.expr(spans[span])


def strict(text: Column) -> Column:
    """The time of a text; a text that holds none is an error of the query."""
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(F.try_to_timestamp(text), F.raise_error(F.concat(F.lit("not a time: "), text)))).cast("timestamp_ntz")


def period_days(later: Column, earlier: Column) -> Column:
    """Whole days of a period, 1 at least."""
    return F.greatest(F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)).cast("bigint"), F.lit(1))


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour spans between, truncated towards zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return (micros / F.lit(86_400_000_000)).cast("int")
