"""Microsecond arithmetic on zone-less timestamps (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 3600 * SECOND_US
DAY_US = 24 * HOUR_US


def micros(column) -> Column:
    """Epoch microseconds of a timestamp column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def from_micros(column) -> Column:
    """Zone-less timestamp of epoch microseconds."""
    column = F.col(column) if isinstance(column, str) else column
    return F.timestamp_micros(column).cast("timestamp_ntz")


def block_of(us: Column, width_us: int) -> Column:
    """Number of the fixed-width time block a microsecond value lies in."""
    return F.floor(us / F.lit(width_us)).cast("bigint")


def floor_to(column, width: str) -> Column:
    """Start of the tumbling window of ``width`` that holds the timestamp."""
    return F.window(column, width)["start"]


def ts_literal(text: str) -> Column:
    """Constant zone-less timestamp; folds, so comparisons with it reach the scan."""
    return F.lit(text).cast("timestamp_ntz")
