"""Top rows, samples of keys and reproducible shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgpulse.functions.hashing import order_hash


# Reducers that share the rows of one group in the first round.
_SHARES = 256


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 100) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``, in two rounds.

    Each map task cuts its rows to ``n`` per group before the shuffle. On a large
    table that still leaves ``n`` rows of a common group from every one of many
    tasks, so the first round ranks them in shares by map task, and the second ranks
    the shares' best. Any sharing gives the same result.
    """
    share = F.pmod(F.spark_partition_id(), F.lit(_SHARES))
    shared = df.withColumn("_share", share)
    in_share = F.row_number().over(Window.partitionBy(*keys, "_share").orderBy(*order))
    best = shared.withColumn("_best", in_share).where(F.col("_best") <= n).drop("_best", "_share")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return best.withColumn("rank", rank).where(F.col("rank") <= n)


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows overall; each task keeps only its own best ``n``."""
    return df.orderBy(*order).limit(n)


def sample_tickers(tickers: DataFrame, n: int = 200, salt: str = "round-1") -> DataFrame:
    """min(n, all) tickers without replacement; vary the salt per round."""
    return first_n(tickers.select("ticker").distinct(), [order_hash(salt, F.col("ticker")), F.col("ticker")], n)


def shuffled(df: DataFrame, key: str = "id", salt: str = "shuffle") -> DataFrame:
    """A reproducible random order, produced by a range-partitioned sort."""
    return df.orderBy(order_hash(salt, F.col(key)), F.col(key))
