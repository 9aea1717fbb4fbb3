"""Sentiment aggregates over the message table and the fetch log.

Every grouping is a partial plus a final hash aggregate, so a ticker that holds a
third of all rows is reduced inside each map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.functions.times import day_of, hour_label, hour_of, minutes_bucket
from msgpulse.operators.filters import created_between, fetch_outcome, labelled
from msgpulse.schema import BEARISH, BULLISH, UNCERTAIN


def _sentiment_by(messages: DataFrame, bucket: Column, name: str) -> DataFrame:
    return (
        labelled(messages)
        .groupBy("ticker", bucket.alias(name))
        .agg(F.avg("sentiment").alias("bullish_ratio"), F.count(F.lit(1)).alias("n"))
    )


def daily_sentiment(messages: DataFrame) -> DataFrame:
    """Share of bullish messages and message count per ticker and day."""
    return _sentiment_by(messages, day_of(F.col("created_at")), "day")


def hourly_sentiment(messages: DataFrame, lo=None, hi=None) -> DataFrame:
    """The hourly form, with its display label, within an optional time range."""
    if lo is not None or hi is not None:
        messages = created_between(messages, lo, hi)
    hourly = _sentiment_by(messages, hour_of(F.col("created_at")), "hour")
    return hourly.withColumn("label", hour_label(F.col("hour")))


def bucketed_sentiment(messages: DataFrame, minutes: int) -> DataFrame:
    """Finer time buckets of a chosen width."""
    return _sentiment_by(messages, minutes_bucket(F.col("created_at"), minutes), "bucket")


def in_time_order(series: DataFrame, bucket: str) -> DataFrame:
    return series.orderBy("ticker", bucket)


def class_histogram(messages: DataFrame, column: str = "sentiment") -> DataFrame:
    """Rows per class, missing left out, the largest first."""
    return (
        messages.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
    )


def store_counts(messages: DataFrame) -> DataFrame:
    """Rows per ticker store plus the grand total, which is marked ``is_total``."""
    per_store = messages.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return per_store.rollup("ticker").agg(
        F.sum("n").alias("n"), (F.grouping("ticker") == 1).alias("is_total")
    )


def fetch_tally(fetch_log: DataFrame) -> DataFrame:
    """Fetches per outcome; a good fetch that brought nothing new is its own outcome."""
    outcome = F.when((F.col("status") == 200) & (F.col("n_rows") == 0), F.lit("no_new_rows")).otherwise(
        fetch_outcome()
    )
    return fetch_log.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def distinct_symbols(listings: DataFrame) -> DataFrame:
    return listings.select("ticker").where(F.col("ticker").isNotNull()).distinct()


def class_sizes(messages: DataFrame, share: float = 0.75) -> DataFrame:
    """Class counts and the balanced sample size, a share of the bearish class."""
    counts = messages.agg(
        F.count_if(F.col("sentiment") == BULLISH).alias("n_bull"),
        F.count_if(F.col("sentiment") == BEARISH).alias("n_bear"),
    )
    return counts.withColumn("sample_size", F.floor(F.col("n_bear") * F.lit(share)).cast("long"))


def migration_parity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per store: uncertain codes and NULL labels before against NULL labels after."""
    without = F.col("sentiment").isNull() | (F.col("sentiment") == UNCERTAIN)
    before = old.groupBy("ticker").agg(
        F.count_if(F.col("sentiment") == UNCERTAIN).alias("sentinels_before"),
        F.count_if(F.coalesce(without, F.lit(False))).alias("_without"),
    )
    after = new.groupBy("ticker").agg(F.count_if(F.col("sentiment").isNull()).alias("nulls_after"))
    return (
        before.join(after, "ticker", "full_outer")
        .select(
            "ticker",
            F.coalesce("sentinels_before", F.lit(0)).alias("sentinels_before"),
            F.coalesce("nulls_after", F.lit(0)).alias("nulls_after"),
            (F.coalesce("_without", F.lit(0)) == F.coalesce("nulls_after", F.lit(0))).alias("same"),
        )
    )
