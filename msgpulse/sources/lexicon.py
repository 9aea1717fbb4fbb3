"""Curation lists: spam phrases and hand-checked message ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------
SPAM_PHRASES = [
    "smartoptions®",
    "technical alerts",
    ": available to subscribers",
    "evolution trading",
    "trade alerts",
    "trading community",
    "trading alerts",
    "sweepcast.com",
    "optionpros",
    "freedomstocks.ca",
    "thetradexchange",
    "capotrades",
    "pineapplestocks.com",
    "alert triggered",
    "xtradesb",
    "option-alerts.com",
    "options alert",
    "alerts triggered",
    "assetdash.com",
    "news digest",
    "beststocksnowapp.com",
    "drstoxx.com",
    "echelon-1.com",
    "wallstjesus.com",
    "trendspider.com",
    "gainers watchlist",
    "freedom stocks",
    "#optionstradingpulse",
    "vwapindicator",
    "on notifications",
    "trade ideas",
    "(delayed)",
    "follow for",
    "📈🚀 symbol:",
    "delayed]",
    "[delayed",
    "today&#39;s biggest market cap",
    "trade-ideas.com",
]

FORCED_SPAM_IDS = [
    "189934349", "142590793", "185792536", "182362237", "226578494",
    "174519289", "240723002", "242183678", "248681269", "245656196",
    "243413941", "239273922", "230980738", "255520798", "158019671",
    "252711617", "252527668", "247522334", "251021498", "207262771",
]

FORCED_HAM_IDS = [
    "210916827", "86743375", "216738976", "236216134", "203164333",
    "180138622", "206200249", "127735161", "218513852", "211814549",
    "215246245", "251010890", "207338547", "233435151", "240829277",
    "220170011", "136139256", "219269972", "231359105", "166400184",
    "246096363", "136017785", "222582653", "247547045", "210906734",
    "247247993", "201056424", "256665740", "114878188", "241643844",
    "192309512", "173490639", "173353164",
]
# ------------------------------------------------------------------------------------


def relation(spark: SparkSession, values: Sequence[str], column: str) -> DataFrame:
    """An inline list as a one-column relation, broadcast because its length is fixed here."""
    return F.broadcast(spark.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} string"))


def spam_phrases(spark: SparkSession) -> DataFrame:
    return relation(spark, SPAM_PHRASES, "phrase")


def forced_spam(spark: SparkSession) -> DataFrame:
    return relation(spark, FORCED_SPAM_IDS, "id")


def forced_ham(spark: SparkSession) -> DataFrame:
    return relation(spark, FORCED_HAM_IDS, "id")
