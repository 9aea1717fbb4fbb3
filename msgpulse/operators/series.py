"""Series built on the daily and hourly aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgpulse.operators.aggregates import daily_sentiment


def relative_sentiment(messages: DataFrame, trailing: int = 30) -> DataFrame:
    """Daily share as a z-score against the ticker's preceding observed days.

    The window runs over the daily aggregate (one row per ticker and day).
    """
    before = Window.partitionBy("ticker").orderBy("day").rowsBetween(-trailing, -1)
    base = F.avg("bullish_ratio").over(before)
    spread = F.stddev_samp("bullish_ratio").over(before)
    return daily_sentiment(messages).withColumn(
        "relative", F.when(spread > 0, (F.col("bullish_ratio") - base) / spread)
    )


def price_correlation(daily: DataFrame, prices: DataFrame, lag_days: int = 0) -> DataFrame:
    """Correlation per ticker of daily sentiment with the close ``lag_days`` observed days later.

    ``prices(ticker, day, close)`` has one row per ticker and trading day, so the day after
    Friday is Monday; rows are met by an equi-join on (ticker, day).
    """
    by_day = Window.partitionBy("ticker").orderBy("day")
    later = F.lead("close", lag_days).over(by_day) if lag_days else F.col("close")
    shifted = prices.select("ticker", "day", later.alias("close")).where("close IS NOT NULL")
    return (
        daily.join(shifted, ["ticker", "day"])
        .groupBy("ticker")
        .agg(F.corr("bullish_ratio", "close").alias("correlation"), F.count(F.lit(1)).alias("n_days"))
    )
