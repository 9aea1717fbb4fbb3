"""Look-ups by id or ticker: semi, anti and overlay joins.

No join here carries a fixed broadcast hint on caller data. Spark broadcasts a
side when its size is known to be small (stored tables, inline lists) and
otherwise shuffles both, splitting skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.functions.text import CASHTAG_PATTERN, cashtags
from msgpulse.operators.dedup import first_per_key


def rows_in(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in the set; ids that match nothing are ignored."""
    return df.join(ids.select(key), key, "left_semi")


def rows_not_in(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def unmatched_ids(ids: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """How many ids of a list are absent from the data (one row)."""
    return ids.select(key).distinct().join(df.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))


def union_ids(*id_sets: DataFrame, key: str = "id") -> DataFrame:
    """Set union of id lists."""
    united = id_sets[0].select(key)
    for more in id_sets[1:]:
        united = united.union(more.select(key))
    return united.distinct()


def absent_from(batch: DataFrame, target: DataFrame, keys: Sequence[str] = ("ticker", "id")) -> DataFrame:
    """Batch rows whose key the target does not hold yet.

    First the target's key columns are reduced to the keys the batch asks for (the
    small batch is the side Spark can broadcast, and its tickers prune the
    target's partitions), then the batch drops those. The target is not shuffled as
    long as the batch's keys fit the broadcast threshold. Keys are text columns.
    """
    asked, stored = batch.alias("asked"), target.select(*keys).alias("stored")
    # Messages without a ticker are recognised as well. Plain equality of these
    # expressions, unlike <=>, still prunes the target's partitions; so that Spark
    # tries, the pruning side has to have a filter, which here is true of every row.
    same = reduce(
        and_, (F.coalesce(f"asked.{k}", F.lit("")) == F.coalesce(f"stored.{k}", F.lit("")) for k in keys)
    )
    every_key = asked.where(F.coalesce(f"asked.{keys[0]}", F.lit("")) >= "")
    taken = stored.join(every_key, same, "left_semi").alias("stored")
    return asked.join(taken, same, "left_anti").select("asked.*")


def overlay_spam_flags(messages: DataFrame, spam_ids: DataFrame, ham_ids: DataFrame, flag: Column | None = None) -> DataFrame:
    """Set ``is_spam`` from two id lists; an id on both lists is spam.

    Rows on neither list keep ``flag`` (NULL, "unknown", unless given).
    """
    flags = (
        spam_ids.select("id", F.lit(1).alias("_flag"))
        .unionByName(ham_ids.select("id", F.lit(0).alias("_flag")))
        .groupBy("id")
        .agg(F.max("_flag").alias("_flag"))
    )
    otherwise = F.lit(None).cast("int") if flag is None else flag
    return messages.join(flags, "id", "left").withColumn("is_spam", F.coalesce("_flag", otherwise).cast("int")).drop("_flag")


def with_predictions(messages: DataFrame, predictions: DataFrame) -> DataFrame:
    """Back-filled view: stored labels win, otherwise the newest prediction applies.

    ``predictions(id, sentiment, model_version)`` is append-only; the highest
    version of an id is used.
    """
    newest = first_per_key(
        predictions.select("id", F.col("sentiment").alias("_predicted"), "model_version"),
        ["id"],
        [F.desc("model_version"), F.asc("_predicted")],
    ).drop("model_version")
    return (
        messages.join(newest, "id", "left")
        .withColumn("sentiment", F.coalesce("sentiment", "_predicted"))
        .drop("_predicted")
    )


def ticker_mentions(
    messages: DataFrame, tickers: DataFrame, body: str = "body", pattern: str = CASHTAG_PATTERN
) -> DataFrame:
    """One row per message and listed ticker it mentions.

    Mentions are pulled out of each text once and met with the list by an
    equi-join; no text is compared with every ticker.
    """
    mentioned = messages.withColumn("mention", F.explode(cashtags(F.col(body), pattern)))
    listed = tickers.select(F.upper("ticker").alias("mention")).distinct()
    return mentioned.join(listed, "mention")
