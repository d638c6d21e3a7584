"""Epoch arithmetic that does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _since(unit: str, ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff(unit, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")).cast("bigint")


def millis(ts: str | Column) -> Column:
    """Milliseconds since 1970 of a wall-clock time."""
    return _since("MILLISECOND", ts)


def micros(ts: str | Column) -> Column:
    return _since("MICROSECOND", ts)
