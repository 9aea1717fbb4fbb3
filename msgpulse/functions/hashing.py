"""Reproducible stand-ins for random order, random split and generated ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(salt: str, key: Column) -> Column:
    """A fixed pseudo-random sort key per row."""
    return F.md5(F.concat(F.lit(salt), key.cast("string")))


def prefix_of(digest: Column, hex_digits: int) -> Column:
    """Leading hex digits of a digest as a number."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")


def unit_hash(salt: str, key: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) per row."""
    return prefix_of(order_hash(salt, key), 8) / F.lit(4294967296.0)


def surrogate_id(*parts: Column) -> Column:
    """An id derived from content, so a retried load creates the same rows."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
