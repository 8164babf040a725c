"""Event times as integer microseconds, and civil times of a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def to_us(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def civil_to_utc_us(text: Column, zone: str, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """Microseconds of a civil time written in ``zone``; null where it can't be read."""
    return F.unix_micros(F.to_utc_timestamp(F.try_to_timestamp(text, F.lit(pattern)), zone))
