"""Feed adapters: landed JSON payloads to messages.

An adapter is a function ``raw frame -> message frame`` that works on batch and
streaming frames alike. ``ADAPTERS`` is the registry; ``messages_from`` unites
several feeds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from msgpulse.functions.labels import decode_label, decode_label_strict
from msgpulse.functions.times import from_epoch, parse_time
from msgpulse.operators.combine import union_by_name
from msgpulse.operators.filters import english_with_cashtag, within_last_day
from msgpulse.operators.keyed import ticker_mentions
from msgpulse.operators.ranking import top_per_group
from msgpulse.schema import REDDIT, STOCKTWITS, TWITTER, conform

# --- fixed values: searched communities, search size, payload fields -------------------
COMMUNITIES = ["stocks", "wallstreetbets", "investing"]
SEARCH_LIMIT = 100
WORD_PATTERN = r"([A-Za-z][A-Za-z.]*)"

_STOCKTWITS = (
    "ticker STRING, messages ARRAY<STRUCT<id: BIGINT, body: STRING, created_at: STRING, "
    "user: STRUCT<id: STRING>, entities: {entities}, "
    "likes: STRUCT<total: BIGINT>, conversation: STRUCT<replies: BIGINT>>>"
)
PAYLOADS = {
    "stocktwits": _STOCKTWITS.format(entities="STRUCT<sentiment: STRUCT<basic: STRING>>"),
    "stocktwits_strict": _STOCKTWITS.format(entities="VARIANT"),
    "twitter": (
        "data ARRAY<STRUCT<id: STRING, text: STRING, author_id: STRING, created_at: STRING, "
        "lang: STRING, public_metrics: STRUCT<like_count: BIGINT>>>"
    ),
    "reddit": (
        "kind STRING, id STRING, title STRING, selftext STRING, author STRUCT<name: STRING>, "
        "created_utc DOUBLE, score BIGINT, num_comments BIGINT, subreddit STRING, relevance DOUBLE"
    ),
}
# ---------------------------------------------------------------------------------------


def landed(spark: SparkSession, payload: str, path: str) -> DataFrame:
    """Landed payload files of one feed as a batch frame."""
    return spark.read.schema(PAYLOADS[payload]).json(path)


def _parsed(lines: DataFrame, payload: str) -> DataFrame:
    """``value`` lines with ``file`` as ``payload`` (null if unreadable), ``file``, ``record``, ``bad``."""
    schema = f"{PAYLOADS[payload]}, _corrupt_record STRING"
    read = lines.where(F.length(F.trim("value")) > 0).withColumn(
        "payload", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    )
    bad = F.col("payload").isNull() | F.col("payload._corrupt_record").isNotNull()
    return read.select("payload", "file", F.col("value").alias("record"), bad.alias("bad"))


def landed_and_rejects(spark: SparkSession, payload: str, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Payloads that could be read, and the (file, record) of those that could not.

    ``multi_line`` takes a whole file as one payload, as pretty-printed ones are.
    """
    text = spark.read.text(path, wholetext=multi_line).select("value", F.col("_metadata.file_path").alias("file"))
    read = _parsed(text, payload)
    return read.where(~F.col("bad")).select("payload.*").drop("_corrupt_record"), read.where("bad").select("file", "record")


def counted_landed(spark: SparkSession, payload: str, path: str, counts: Observation) -> DataFrame:
    """``landed`` that counts what it cannot read: ``counts`` gets ``lines`` and ``rejected``
    once the frame has run (lines cut short or not JSON); the frame holds the readable payloads."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    read = _parsed(text, payload).observe(
        counts, F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("rejected")
    )
    return read.where(~F.col("bad")).select("payload.*").drop("_corrupt_record")


def landing_and_rejects(spark: SparkSession, payload: str, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed lines as one stream: ``payload``, ``file``, ``record`` and ``bad`` per line.

    ``streaming.feeds.ingest_with_rejects`` sends both kinds on from one micro-batch.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return _parsed(lines.select("value", F.col("_metadata.file_path").alias("file")), payload)


def landing(spark: SparkSession, payload: str, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same files as an endless stream of arrivals.

    ``files_per_trigger`` only divides the work, so that a backlog is no single round.
    """
    return spark.readStream.schema(PAYLOADS[payload]).option("maxFilesPerTrigger", files_per_trigger).json(path)


def stocktwits_messages(raw: DataFrame, strict_compat: bool = False) -> DataFrame:
    """``messages`` arrays to rows; absent nested fields get their defaults.

    ``strict_compat`` needs the ``stocktwits_strict`` payload schema, which keeps
    "missing" and "null" labels apart.
    """
    m = raw.select("ticker", F.explode("messages").alias("m"))
    if strict_compat:
        sentiment = decode_label_strict(F.col("m.entities"))
    else:
        sentiment = decode_label(F.col("m.entities.sentiment.basic"))
    return conform(
        m.select(
            F.col("m.id").cast("string").alias("id"),
            F.col("m.body").alias("body"),
            F.coalesce(F.col("m.user.id"), F.lit("")).alias("author"),
            parse_time(F.col("m.created_at")).alias("created_at"),
            sentiment.alias("sentiment"),
            F.lit(STOCKTWITS).alias("source"),
            F.col("m.likes.total").alias("likes"),
            F.col("m.conversation.replies").alias("replies"),
            "ticker",
        )
    )


def twitter_messages(raw: DataFrame) -> DataFrame:
    """``data`` arrays to rows: English posts with a cashtag, unlabelled."""
    tweets = english_with_cashtag(raw.select(F.explode("data").alias("t")), "t.lang", "t.text")
    return conform(
        tweets.select(
            F.col("t.id").alias("id"),
            F.col("t.text").alias("body"),
            F.coalesce(F.col("t.author_id"), F.lit("")).alias("author"),
            parse_time(F.col("t.created_at")).alias("created_at"),
            F.lit(TWITTER).alias("source"),
            F.col("t.public_metrics.like_count").alias("likes"),
        )
    )


def _submission_columns(raw: DataFrame) -> DataFrame:
    """Submissions only; comments and other kinds have no message form."""
    text = F.concat(F.coalesce("title", F.lit("")), F.coalesce("selftext", F.lit("")))
    return raw.where((F.col("kind") == "submission") & F.col("subreddit").isin(COMMUNITIES)).select(
        "id",
        text.alias("body"),
        F.col("author.name").alias("author"),
        from_epoch(F.col("created_utc")).alias("created_at"),
        F.lit(REDDIT).alias("source"),
        F.col("score").alias("likes"),
        F.col("num_comments").alias("replies"),
        "relevance",
    )


def reddit_messages(raw: DataFrame) -> DataFrame:
    """Submissions of the searched communities as messages (also as a stream)."""
    return conform(_submission_columns(raw))


def reddit_search(raw: DataFrame, tickers: DataFrame, as_of, limit: int = SEARCH_LIMIT) -> DataFrame:
    """The last day's submissions naming a listed ticker, best ``limit`` per ticker."""
    recent = within_last_day(_submission_columns(raw), as_of)
    named = ticker_mentions(recent, tickers, pattern=WORD_PATTERN).withColumnRenamed("mention", "ticker")
    best = top_per_group(named, ["ticker"], [F.col("relevance").desc_nulls_last(), F.col("id")], limit)
    return conform(best, extra=["relevance", "rank"])


def twitter_search(raw: DataFrame, tickers: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """English posts that name a listed ticker as a cashtag, the latest ``limit`` per ticker, each with its ticker."""
    named = ticker_mentions(twitter_messages(raw).drop("ticker"), tickers).withColumnRenamed("mention", "ticker")
    best = top_per_group(named, ["ticker"], [F.col("created_at").desc_nulls_last(), F.col("id")], limit)
    return conform(best, extra=["rank"])


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "stocktwits": stocktwits_messages,
    "twitter": twitter_messages,
    "reddit": reddit_messages,
}


def messages_from(raws: Mapping[str, DataFrame], sources: list[str] | None = None) -> DataFrame:
    """Unite the named feeds; a feed that was not landed simply contributes nothing."""
    wanted = [s for s in (sources or list(ADAPTERS)) if s in raws]
    if not wanted:
        raise ValueError("none of the requested feeds has landed data")
    return union_by_name(*[ADAPTERS[s](raws[s]) for s in wanted])
