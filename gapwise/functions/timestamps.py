"""Time columns: epoch seconds as DOUBLE are the ordering key everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the accepted text forms of a timestamp
NUMBER_FORM = r"^[+-]?\d+(\.\d+)?$"
RFC3339_FORM = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"


def epoch_seconds(ts: Column) -> Column:
    """Timestamp column to epoch seconds; zone-less timestamps are read in the session time zone."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def parse_epoch(text: Column) -> Column:
    """Numeric text or RFC 3339 with 0-9 fraction digits; NULL when invalid.

    Impossible dates (31 February), hours above 23 and offsets above 23:59 are
    invalid.
    """
    t = F.trim(text)

    def part(i: int) -> Column:
        return F.regexp_extract(t, RFC3339_FORM, i)

    day = F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd")
    hh, mm, ss = (part(i).try_cast("int") for i in (4, 5, 6))
    digits, zone = part(7), part(8)
    fraction = F.when(digits == "", 0.0).otherwise(
        digits.try_cast("double") / F.pow(F.lit(10.0), F.length(digits))
    )
    off_h, off_m = (F.substring(zone, i, 2).try_cast("int") for i in (2, 5))
    offset = F.when(zone == "Z", 0).otherwise(
        (off_h * 3600 + off_m * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    )
    ok = day.isNotNull() & (hh <= 23) & (mm <= 59) & (ss <= 59)
    ok = ok & ((zone == "Z") | ((off_h <= 23) & (off_m <= 59)))
    seconds = F.unix_date(day) * 86400 + hh * 3600 + mm * 60 + ss - offset
    return F.when(t.rlike(NUMBER_FORM), t.try_cast("double")).when(
        t.rlike(RFC3339_FORM) & ok, seconds + fraction
    )


def guess_epoch(text: Column) -> Column:
    """Numbers of 1e12 and more are milliseconds, smaller ones seconds; else ISO text."""
    number = F.trim(text).try_cast("double")
    return F.when(
        number.isNotNull(), F.when(F.abs(number) >= 1e12, number / 1000).otherwise(number)
    ).otherwise(parse_epoch(text))


def utc_hour(epoch: Column) -> Column:
    """Hour of day from epoch seconds."""
    return F.floor(F.pmod(epoch, F.lit(86400.0)) / 3600).cast("int")
