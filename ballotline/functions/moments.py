"""Whole minutes and calendar parts of ISO-8601 texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date and time of the day at the start of a text; what stands between the digits is not looked at.
_MOMENT = r"(?s)\A[0-9]{4}.(?:0[1-9]|1[0-2]).(?:0[1-9]|[12][0-9]|3[01]).(?:[01][0-9]|2[0-3]).[0-5][0-9]"


def iso_minutes(s: Column) -> Column:
    """Minutes since 1970 of a text of at least 19 characters, null if it isn't a time.

    Separators, seconds and zone don't count. Days that a month lacks roll over: February 31 is March 3.
    """
    year, month, day, hour, minute = (F.substring(s, at, n).try_cast("int") for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2)))
    days = F.unix_date(F.date_add(F.make_date(year, month, F.lit(1)), day - 1)).cast("long")
    return F.when(s.rlike(_MOMENT) & (F.octet_length(s) >= 19), days * 1440 + hour * 60 + minute)


def hour_of(minutes: Column) -> Column:
    """Hour of the day of minutes since 1970."""
    return F.floor(F.pmod(minutes, F.lit(1440)) / 60).cast("int")


def weekday_of(minutes: Column) -> Column:
    """Day of the week of minutes since 1970, Monday 0."""
    return F.pmod(F.floor(minutes / 1440) + 3, F.lit(7)).cast("int")


def minutes_since(now: Column, last: Column) -> Column:
    """Minutes from ``last`` to ``now``, both whole minutes already; 0 if it lies ahead, null without one."""
    return F.when(last.isNull() | now.isNull(), None).when(now < last, 0).otherwise(now - last).cast("long")
