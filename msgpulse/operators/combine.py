"""Unions by name and the cleaning chain over a combined corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.functions.labels import remap_legacy
from msgpulse.functions.text import strip_urls
from msgpulse.operators.dedup import first_message_per_id
from msgpulse.schema import conform


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Bag union aligned by column name; a column one side lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def consolidated(*corpora: DataFrame) -> DataFrame:
    """Corpora in the message layout under one another, nothing removed."""
    return union_by_name(*[conform(c) for c in corpora])


def cleaned(messages: DataFrame, priority: Column | None = None) -> DataFrame:
    """Dedup by id, strip URLs, remap the legacy bearish code."""
    return first_message_per_id(messages, priority).withColumns(
        {"body": strip_urls(F.col("body")), "sentiment": remap_legacy(F.col("sentiment"))}
    )
