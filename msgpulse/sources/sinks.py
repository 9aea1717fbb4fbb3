"""Batch sinks: partitioned Parquet, CSV append, insert-if-absent, predictions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from msgpulse.operators.dedup import first_per_key
from msgpulse.sources import compaction
from msgpulse.operators.filters import valid
from msgpulse.operators.keyed import absent_from
from msgpulse.schema import CSV_COLUMNS, MESSAGE_COLUMNS, MESSAGE_SCHEMA, in_order
from msgpulse.session import setting

PREDICTION_SCHEMA = "id STRING, sentiment INT, model_version STRING"
STORE_KEYS = ("ticker", "id")

_EMPTY_STAGE_RULE = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


#: Distinct ids a Bloom filter of one row group is sized for (false positives 1 %); the writer
#: picks a smaller filter where a row group holds fewer.
BLOOM_IDS = 100_000


def write_parquet(
    messages: DataFrame,
    path: str,
    mode: str = "errorifexists",
    compression: str = "zstd",
    row_group_bytes: int | None = None,
) -> None:
    """Write a message table partitioned by ticker and sorted by time within files.

    The rebalance brings a ticker's rows together into files of the advisory size:
    small tickers share tasks, and one that holds a large share of all messages
    is split over as many tasks as its size asks for. Every row group carries a Bloom
    filter of its ids: ids are not sorted within files, so only these let a look-up
    of a few ids skip row groups (see ``probed``).
    """
    writer = (
        messages.hint("rebalance", F.col("ticker"))
        .sortWithinPartitions("ticker", "created_at", "id")
        .write.mode(mode)
        .option("compression", compression)
        .option("parquet.bloom.filter.enabled#id", "true")
        .option("parquet.bloom.filter.expected.ndv#id", str(BLOOM_IDS))
        .option("parquet.bloom.filter.adaptive.enabled", "true")
    )
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.partitionBy("ticker").parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A stored message table in canonical column order."""
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path).select(*MESSAGE_COLUMNS)


def append_csv(messages: DataFrame, path: str) -> None:
    """Append in the fixed header order, one header per file."""
    (
        in_order(messages, CSV_COLUMNS)
        .write.mode("append")
        .option("header", True)
        .option("escape", '"')
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


def create_if_absent(spark: SparkSession, path: str) -> None:
    """An empty message table, unless there is one already."""
    empty = spark.createDataFrame([], MESSAGE_SCHEMA)
    empty.write.mode("ignore").partitionBy("ticker").parquet(path)


def new_rows(
    batch: DataFrame, target: DataFrame, keys: Sequence[str] = STORE_KEYS, id_range: tuple[str, str] | None = None
) -> DataFrame:
    """What insert-if-absent would add: rows not yet stored, one per key.

    ``id_range`` is the smallest and largest id of the batch where the caller knows
    them; stored files outside it are then skipped by their statistics.
    """
    if id_range is not None:
        target = target.where(F.col("id").between(*id_range))
    first = [F.col(c).asc_nulls_last() for c in ("created_at", "body", "author", "sentiment")]
    return first_per_key(absent_from(batch, target, keys), keys, first)


#: Batches of at most so many rows look their keys up instead of joining with all stored keys.
PROBE_LIMIT = 1000


def probed(target: DataFrame, asked: Sequence[tuple[str, str]]) -> DataFrame:
    """Stored rows that may hold one of the asked (ticker, id) keys.

    The tickers prune folders; the ids go to the Parquet reader as an OR of ``IN`` lists no longer
    than ``spark.sql.parquet.pushdown.inFilterThreshold``, the length up to which the reader tests
    each id against a row group's Bloom filter (longer lists become a range, which prunes nothing
    here). Row groups without any asked id are not read.
    """
    spark = target.sparkSession
    most = max(1, int(spark.conf.get("spark.sql.parquet.pushdown.inFilterThreshold", "10")))
    tickers = sorted({t for t, _ in asked})
    ids = sorted({i for _, i in asked})
    some_id = reduce(or_, [F.col("id").isin(ids[k : k + most]) for k in range(0, len(ids), most)])
    return target.where(F.col("ticker").isin(tickers) & some_id)


def insert_if_absent(
    batch: DataFrame,
    path: str,
    keys: Sequence[str] = STORE_KEYS,
    id_range: tuple[str, str] | None = None,
    probe_limit: int = PROBE_LIMIT,
) -> dict:
    """Add the batch's new messages to a stored table; repeating a call adds nothing.

    A batch of at most ``probe_limit`` rows whose keys are all present and not empty reads
    only the stored rows that may hold its keys (``probed``: folders of its tickers, row groups
    whose Bloom filter holds one of its ids); a larger one joins with all stored keys. Both give
    the same rows. Returns the counts taken while writing: rows seen, rejected by the NOT NULL
    gate and inserted, and ``status`` ``ok`` or ``no_new_rows``, plus ``probed``. One writer per
    table is assumed.
    """
    spark = batch.sparkSession
    gate, written = Observation(), Observation()
    create_if_absent(spark, path)
    compaction.recover(spark, path)  # a compaction stopped halfway is finished or dropped first
    target = read_messages(spark, path)
    few = None
    if tuple(keys) == STORE_KEYS and probe_limit > 0:
        few = [tuple(r) for r in batch.select(*keys).limit(probe_limit + 1).collect()]  # at most probe_limit + 1 rows
        if len(few) > probe_limit or not few or any(not k for key in few for k in key):
            few = None
    if few is not None:
        target = probed(target, few)
    fresh = new_rows(valid(batch.select(*MESSAGE_COLUMNS), gate), target, keys, id_range)
    # A stage that turns out empty is otherwise replaced at run time, its counters with it.
    # Inside a stream's batch function adaptive execution is off unless asked for.
    with (
        setting(spark, "spark.sql.adaptive.enabled", "true"),
        setting(spark, "spark.sql.adaptive.optimizer.excludedRules", _EMPTY_STAGE_RULE),
    ):
        write_parquet(fresh.observe(written, F.count(F.lit(1)).alias("inserted")), path, mode="append")
    inserted = written.get["inserted"]
    return {**gate.get, "inserted": inserted, "status": "ok" if inserted else "no_new_rows", "probed": few is not None}


def append_predictions(predictions: DataFrame, path: str) -> None:
    """Keyed label updates as appended rows; ``with_predictions`` applies them."""
    predictions.select("id", F.col("sentiment").cast("int"), F.col("model_version").cast("string")).write.mode(
        "append"
    ).parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_SCHEMA).parquet(path)


def archive_hourly(hourly: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Hourly ratios per ticker, stored by day so a range of days prunes to its folders."""
    hourly.withColumn("day", F.to_date("hour")).hint("rebalance", F.col("day")).write.mode(mode).partitionBy("day").parquet(path)
