"""The message record: codes, column orders, Spark schemas and the conform step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: label codes, source tags and column orders ---------------
BULLISH = 1
BEARISH = 0
UNCERTAIN = -69
UNKNOWN_SPAM = -69

STOCKTWITS = "StockTwits"
TWITTER = "Twitter"
REDDIT = "Reddit"
FIQA = "FIQA"

STORE_COLUMNS = ["id", "body", "author", "created_at", "sentiment", "source", "likes", "replies"]
CSV_COLUMNS = ["id", "body", "author", "created_at", "source", "sentiment", "likes", "replies"]
RECORD_COLUMNS = ["body", "id", "created_at", "sentiment", "likes", "replies", "source", "author"]
REQUIRED_COLUMNS = ["id", "body", "author", "created_at", "source"]
# -----------------------------------------------------------------------------

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("sentiment", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("likes", T.LongType()),
        T.StructField("replies", T.LongType()),
        T.StructField("ticker", T.StringType()),
    ]
)
MESSAGE_COLUMNS = MESSAGE_SCHEMA.fieldNames()

_DEFAULTS = {"likes": 0, "replies": 0}


def all_required() -> Column:
    """True when every mandatory field of the message table is present."""
    condition = F.lit(True)
    for name in REQUIRED_COLUMNS:
        condition = condition & F.col(name).isNotNull()
    return condition


def conform(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Project any frame onto the message table, matching columns by name.

    Absent columns become NULL (or their default), text timestamps are parsed
    leniently and nothing is dropped; use ``filters.valid`` for the NOT NULL gate.
    Columns named in ``extra`` are carried through unchanged.
    """
    present = dict(df.dtypes)
    projected = []
    for field in MESSAGE_SCHEMA.fields:
        if field.name not in present:
            value = F.lit(None)
        elif field.name == "created_at" and present[field.name] == "string":
            value = F.try_to_timestamp(F.col(field.name))
        else:
            value = F.col(field.name)
        value = value.try_cast(field.dataType) if field.name in present else value.cast(field.dataType)
        if field.name in _DEFAULTS:
            value = F.coalesce(value, F.lit(_DEFAULTS[field.name]).cast(field.dataType))
        projected.append(value.alias(field.name))
    return df.select(*projected, *(extra or []))


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select one of the canonical column orders by name."""
    return df.select(*columns)
