"""Column functions over message time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Timestamp text in UTC; an offset is converted, malformed text is NULL."""
    return F.try_to_timestamp(text)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def day_of(created_at: Column) -> Column:
    return F.to_date(created_at)


def hour_of(created_at: Column) -> Column:
    return F.date_trunc("hour", created_at)


def hour_label(hour: Column) -> Column:
    return F.date_format(hour, "MM/dd HH")


def minutes_bucket(created_at: Column, minutes: int) -> Column:
    """Start of the fixed-width bucket, aligned to the epoch."""
    return F.window(created_at, f"{minutes} minutes").getField("start")
