"""Time arithmetic that gives the same answer under every session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.specs import EPOCH, ntz


def from_unix_seconds(seconds: Column) -> Column:
    """Unix seconds as a timestamp_ntz in UTC wall-clock time."""
    return ntz(EPOCH) + F.make_dt_interval(secs=seconds)


def to_unix_seconds(moment: Column) -> Column:
    """Whole Unix seconds of a timestamp_ntz, rounding down."""
    days = F.date_diff(F.to_date(moment), F.lit(EPOCH.date()))
    return (
        days.cast("long") * 86400
        + F.hour(moment) * 3600
        + F.minute(moment) * 60
        + F.second(moment)
    )
