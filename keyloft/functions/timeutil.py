"""Microseconds since the epoch and their ISO form."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_epoch_us(value: int | float | str | datetime) -> int:
    """Seconds, a date (its midnight), or an ISO time, in UTC unless it says otherwise, as microseconds."""
    if isinstance(value, bool):
        raise TypeError("a time can't be boolean")
    if isinstance(value, int | float):
        return round(value * 1_000_000)
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    delta = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp column; the session's time zone should be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def iso(us: Column) -> Column:
    """2024-01-31T23:59:59Z; microseconds are dropped."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss'Z'")
