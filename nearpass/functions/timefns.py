"""Calendar helpers on epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..settings import DAY_S


def epoch_s(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp."""
    return F.unix_seconds(ts)


def day_number(t: Column) -> Column:
    """Days since 1970-01-01 of an epoch second."""
    return F.floor(t / DAY_S)


def day_text(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd")


def local_time(t: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(t), tz)


def local_hour(t: Column, tz: str) -> Column:
    return F.hour(local_time(t, tz))


def daytype(t: Column, tz: str) -> Column:
    return F.when(F.dayofweek(local_time(t, tz)).isin(1, 7), "weekend").otherwise("weekday")


def month_utc(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM")


def iso_week(t: Column) -> Column:
    """ISO year and week, for example 2024-W01."""
    ts = F.timestamp_seconds(t)
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))
