"""Time columns.

Bar times are kept as TIMESTAMP_NTZ holding the UTC wall clock, so that no
result depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utc_clock(ts: Column) -> Column:
    """A TIMESTAMP instant as its UTC wall clock."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)


def local_clock(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_day(utc: Column, zone: str) -> Column:
    return F.to_date(local_clock(utc, zone))


def local_hhmm(utc: Column, zone: str) -> Column:
    local = local_clock(utc, zone)
    return F.format_string("%02d:%02d", F.hour(local), F.minute(local))
