"""Row filters. All are plain predicates, so they reach the file scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from msgpulse.functions.text import contains_any
from msgpulse.schema import BEARISH, BULLISH, UNCERTAIN, all_required


def labelled(messages: DataFrame) -> DataFrame:
    """Rows with a usable label; both NULL and the uncertain code are dropped."""
    return messages.where((F.col("sentiment") != UNCERTAIN) & F.col("sentiment").isNotNull())


def unlabelled(messages: DataFrame, include_uncertain: bool = False) -> DataFrame:
    condition = F.col("sentiment").isNull()
    if include_uncertain:
        condition = condition | (F.col("sentiment") == UNCERTAIN)
    return messages.where(condition)


def created_between(messages: DataFrame, lo, hi) -> DataFrame:
    """Half-open time range; the upper bound itself is excluded."""
    return messages.where((F.col("created_at") >= F.lit(lo)) & (F.col("created_at") < F.lit(hi)))


def english_with_cashtag(messages: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    return messages.where((F.col(lang) == "en") & F.contains(F.col(text), F.lit("$")))


def matching_phrases(messages: DataFrame, phrases: Sequence[str], ignore_case: bool = False) -> DataFrame:
    return messages.where(contains_any(F.col("body"), phrases, ignore_case))


def hams(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("is_spam") == 0)


def bulls(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("sentiment") == BULLISH)


def bears(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("sentiment") == BEARISH)


def valid(messages: DataFrame, observation: Observation | None = None) -> DataFrame:
    """NOT NULL gate on id, body, author, created_at and source.

    Rejected rows are dropped, as the store does; pass an ``Observation`` to have
    them counted in the same pass (metrics ``seen`` and ``rejected``).
    """
    if observation is not None:
        messages = messages.observe(
            observation,
            F.count(F.lit(1)).alias("seen"),
            F.count_if(~all_required()).alias("rejected"),
        )
    return messages.where(all_required())


def within_last_day(messages: DataFrame, as_of) -> DataFrame:
    """Rows created in the day up to ``as_of``; the clock is an argument."""
    end = F.lit(as_of).cast("timestamp")
    return messages.where((F.col("created_at") >= end - F.expr("INTERVAL 1 DAY")) & (F.col("created_at") <= end))


def succeeded(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.where(F.col("status") == 200)


def fetch_outcome(status: Column | None = None) -> Column:
    """Status code to outcome text."""
    status = F.col("status") if status is None else status
    return (
        F.when(status == 200, F.lit("ok"))
        .when(status.isin(429, 403), F.lit("rate_limited"))
        .otherwise(F.concat(F.lit("error "), status.cast("string")))
    )
