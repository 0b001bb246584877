"""Time expressions. Stored times are UTC without a zone; `as_of` is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_OFFSET_HOURS = 5


def ntz(value: str | dt.datetime | dt.date | Column) -> Column:
    """A zone-free timestamp literal (columns pass through)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n))


def local_day(ts: Column, offset: int = LOCAL_OFFSET_HOURS) -> Column:
    """Date `offset` hours behind UTC, without daylight saving; negative offsets lie ahead."""
    return F.to_date(ts - hours(offset))


def local_month(ts: Column) -> Column:
    """Month of the local day, as text such as 2024-03."""
    return F.date_format(local_day(ts), "yyyy-MM")


def age_seconds(ts: Column, as_of: str | dt.datetime | Column) -> Column:
    """Whole seconds from `ts` to `as_of`, rounded down, independent of the session zone."""
    gap = ntz(as_of) - ts

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), gap).cast("bigint")

    seconds = F.floor(F.extract(F.lit("SECOND"), gap))
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + seconds


def time_ago(ts: Column, as_of: str | dt.datetime | Column) -> Column:
    """Short age label: just now, 10sec, 5min, 3hr, 2d, 1w, 4mo, 1y."""
    total = age_seconds(ts, as_of)
    days = F.floor(total / 86400)
    seconds = F.pmod(total, F.lit(86400))

    def label(amount: Column, per: int, unit: str) -> Column:
        return F.concat(F.floor(amount / per).cast("string"), F.lit(unit))

    within_a_day = (
        F.when(seconds < 10, F.lit("just now"))
        .when(seconds < 60, label(seconds, 1, "sec"))
        .when(seconds < 3600, label(seconds, 60, "min"))
        .otherwise(label(seconds, 3600, "hr"))
    )
    return (
        F.when(days <= 0, within_a_day)
        .when(days < 7, label(days, 1, "d"))
        .when(days < 31, label(days, 7, "w"))
        .when(days < 365, label(days, 30, "mo"))
        .otherwise(label(days, 365, "y"))
    )


def display_date(ts: Column) -> Column:
    """UTC date as MM-dd-yyyy."""
    return F.date_format(F.to_date(ts), "MM-dd-yyyy")


def display_day(ts: Column, offset: int = LOCAL_OFFSET_HOURS) -> Column:
    """Local day as MM-dd."""
    return F.date_format(local_day(ts, offset), "MM-dd")
