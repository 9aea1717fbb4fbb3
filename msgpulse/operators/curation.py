"""Weakly labelled spam training set and the ham-filtered corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.functions.text import contains_any
from msgpulse.operators.filters import hams, labelled
from msgpulse.operators.keyed import overlay_spam_flags
from msgpulse.operators.sampling import balance_marked, rest_split
from msgpulse.schema import FIQA, UNKNOWN_SPAM


def unknown_spam(messages: DataFrame) -> DataFrame:
    return messages.withColumn("is_spam", F.lit(None).cast("int"))


def spam_code(messages: DataFrame) -> DataFrame:
    """Export form: unknown is written as its code, not as NULL."""
    return messages.withColumn("is_spam", F.coalesce("is_spam", F.lit(UNKNOWN_SPAM)))


def weak_spam_labels(
    messages: DataFrame,
    phrases: Sequence[str],
    spam_ids: DataFrame,
    ham_ids: DataFrame,
    trusted: Column | None = None,
    ignore_case: bool = False,
) -> DataFrame:
    """The spam training set: labelled rows that a rule or a list decides.

    Ham: a trusted source or a listed ham id. Spam: a phrase match or a listed spam
    id. Spam wins over ham. Each row is decided where it stands, so beside the two
    id look-ups nothing is joined, united or made distinct.
    """
    trusted = F.col("source") == FIQA if trusted is None else trusted
    phrase = contains_any(F.col("body"), phrases, ignore_case)
    by_list = overlay_spam_flags(labelled(messages), spam_ids, ham_ids)
    flag = F.when(phrase | (F.col("is_spam") == 1), 1).when(trusted | (F.col("is_spam") == 0), 0)
    return by_list.withColumn("is_spam", flag.cast("int")).where(F.col("is_spam").isNotNull())


def sentiment_sets(corpus: DataFrame, share: float = 0.75, salt: str = "balance") -> DataFrame:
    """Ham rows with a ``part``: a class-balanced train set, the rest test and val."""
    marked = balance_marked(hams(corpus), share, salt, mark="_train")
    rest = rest_split(marked, salt).withColumn("part", F.when(F.col("_train"), F.lit("train")).otherwise(F.col("part")))
    return rest.drop("_train")
