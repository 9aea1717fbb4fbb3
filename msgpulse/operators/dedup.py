"""One row per key, with a defined survivor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row of every key by the given total order.

    ``row_number() <= 1`` lets Spark cut each map task's rows to one per key
    before the shuffle, so a key holding a large share of the data reaches the
    reducer as at most one row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank <= 1").drop("_rank")


def first_message_per_id(messages: DataFrame, priority: Column | None = None) -> DataFrame:
    """Corpus-level dedup by id: source priority, then oldest, then smallest body."""
    order = ([priority] if priority is not None else []) + [
        F.col(c).asc_nulls_last() for c in ("created_at", "body", "author", "sentiment")
    ]
    return first_per_key(messages, ["id"], order)


def first_message_per_text(messages: DataFrame) -> DataFrame:
    """One message per distinct body, the oldest; ids must be unique.

    The survivors are found on (digest, time, id) alone, and whole messages are then
    met by their unique id: however often one text was copied, its copies never
    come together in one task with their bodies. A message without a body is no copy of
    another and stays, under a key of its own.
    """
    text = F.coalesce(F.sha2("body", 256), F.concat(F.lit("no body "), "id"))
    narrow = messages.select(text.alias("_text"), "created_at", "id")
    survivors = first_per_key(narrow, ["_text"], [F.col("created_at"), F.col("id")])
    return messages.join(survivors.select("id"), "id", "left_semi")
