"""Oldest / newest markers per ticker and the cursor filter built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.operators.ranking import first_n

# --- fixed values: fetch directions -----------------------------------------------
NONE = "NONE"
FORWARD = "FORWARD"
BACKWARD = "BACKWARD"
# ----------------------------------------------------------------------------------

# Larger than any 64-bit id, so that time decides first and the id breaks ties.
_ID_SPAN = "10000000000000000000"


def _number() -> Column:
    return F.expr("try_cast(id AS BIGINT)")


def _time_then_id(descending_ties: bool = False) -> Column:
    """(time, id) as one decimal: comparable, and fixed width for hash aggregation."""
    micros = F.unix_micros(F.col("created_at")).cast("decimal(19,0)")
    number = _number().cast("decimal(19,0)")
    span = F.lit(_ID_SPAN).cast("decimal(20,0)")
    return (micros * span + (-number if descending_ties else number)).cast("decimal(38,0)")


def id_order(column: str = "id") -> Column:
    """Ids as (length, text): whole numbers stand in their order, and ids of letters and digits by length first."""
    return F.struct(F.length(column).alias("length"), F.col(column).alias("text"))


def ticker_markers(messages: DataFrame, min_rows: int = 2) -> DataFrame:
    """Oldest and newest message (id, time) per ticker; ties go to the smallest id.

    Ids may be numbers or text; among equal times numbers stand before text. ``n`` counts the
    messages that can be a marker, those with an id and a time, and tickers with fewer than ``min_rows``
    of them have no markers. Numbers are reduced by one hash aggregate over three narrow
    columns; text ids compare as structs, which Spark aggregates by sorting, so only they are.
    """
    usable = messages.select("ticker", "id", "created_at").where("id IS NOT NULL AND created_at IS NOT NULL")
    numbers = (
        usable.where(_number().isNotNull())
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("created_at").alias("oldest_at"),
            F.max("created_at").alias("newest_at"),
            F.min(_time_then_id()).alias("_oldest"),
            F.max(_time_then_id(descending_ties=True)).alias("_newest"),
        )
        .select(
            "ticker",
            "n",
            _marker("oldest_at", _id_part("_oldest", "oldest_at").cast("string")).alias("oldest"),
            _marker("newest_at", (-_id_part("_newest", "newest_at")).cast("string"), -1).alias("newest"),
        )
    )
    return _merged(numbers.unionByName(_reduced(usable.where(_number().isNull()))), min_rows)


def marker_state(messages: DataFrame) -> DataFrame:
    """The same for every ticker in a single aggregation, as a stream needs it."""
    usable = messages.select("ticker", "id", "created_at").where("id IS NOT NULL AND created_at IS NOT NULL")
    return _reduced(usable).selectExpr("ticker", *_RESULT, "n")


def _reduced(usable: DataFrame) -> DataFrame:
    return usable.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(_marker("created_at", F.col("id"))).alias("oldest"),
        F.min(_marker("created_at", F.col("id"), -1)).alias("newest"),
    )


def _merged(parts: DataFrame, min_rows: int) -> DataFrame:
    merged = parts.groupBy("ticker").agg(F.sum("n").alias("n"), F.min("oldest").alias("oldest"), F.min("newest").alias("newest"))
    return merged.where(F.col("n") >= min_rows).selectExpr("ticker", *_RESULT, "n")


_RESULT = ("oldest.text AS oldest_id", "oldest.at AS oldest_at", "newest.text AS newest_id", "newest.at AS newest_at")


def _marker(at: str, text: Column, sign: int = 1) -> Column:
    """Time (or its negative), numbers before text, then the id's order; the least is the marker."""
    number = text.try_cast("bigint")
    return F.struct(
        (sign * F.unix_micros(at)).alias("order"),
        number.isNull().alias("is_text"),
        F.coalesce(number, F.lit(0)).alias("number"),
        F.length(text).alias("length"),
        text.alias("text"),
        F.col(at).alias("at"),
    )


def _id_part(packed: str, at: str) -> Column:
    """The id term of a packed (time, id) value, given its time."""
    micros = F.unix_micros(F.col(at)).cast("decimal(19,0)")
    span = F.lit(_ID_SPAN).cast("decimal(20,0)")
    return (F.col(packed) - (micros * span).cast("decimal(38,0)")).cast("bigint")


def oldest(messages: DataFrame) -> DataFrame:
    return first_n(messages, [F.col("created_at").asc(), F.col("id").asc()], 1)


def newest(messages: DataFrame) -> DataFrame:
    return first_n(messages, [F.col("created_at").desc(), F.col("id").asc()], 1)


def with_markers(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """Attach each row's ticker markers; tickers without markers get NULLs.

    Pass markers from a stored table: Spark then knows their size and broadcasts
    them when they fit, so the rows themselves are not shuffled.
    """
    return rows.join(markers, "ticker", "left")


def beyond_cursor(rows: DataFrame, markers: DataFrame, direction: str) -> DataFrame:
    """Rows a fetch in the given direction may still bring.

    BACKWARD keeps ids below the oldest marker, FORWARD ids above the newest, in the order of
    ``id_order`` (whole numbers by value); a ticker without markers is not restricted, and a row without an id
    cannot be compared and stays.
    """
    if direction == NONE:
        return rows
    side = "oldest_id" if direction == BACKWARD else "newest_id"
    bound = markers.select("ticker", F.col(side).alias("_bound"))
    number, limit = _number(), F.expr("try_cast(_bound AS BIGINT)")
    below = F.coalesce(number < limit, id_order() < id_order("_bound"))
    above = F.coalesce(number > limit, id_order() > id_order("_bound"))
    keep = below if direction == BACKWARD else above
    open_ended = F.col("_bound").isNull() | F.col("id").isNull()
    return rows.join(bound, "ticker", "left").where(open_ended | keep).drop("_bound")
