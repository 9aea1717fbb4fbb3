"""Structured Streaming forms of the crawl: ingest, markers, live buckets, callbacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from msgpulse.functions.times import hour_label
from msgpulse.operators.filters import labelled
from msgpulse.operators.markers import _RESULT, marker_state
from msgpulse.session import materialise
from msgpulse.sources.sinks import STORE_KEYS, insert_if_absent


def _started(frame: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str, drain: bool) -> StreamingQuery:
    writer = frame.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def for_each_batch(
    messages: DataFrame, processing: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = False
) -> StreamingQuery:
    """Hand every arrival to a user function, one micro-batch frame at a time."""
    return _started(messages, processing, checkpoint, "append", drain)


def ingest(
    messages: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str] = STORE_KEYS,
    on_result: Callable[[int, dict], None] | None = None,
    drain: bool = False,
) -> StreamingQuery:
    """Endless convert and insert-if-absent into a stored table.

    There is no watermark: a back-fill brings older messages with every round, and
    uniqueness comes from the key look-up in the table, which also makes a
    replayed micro-batch harmless. ``on_result`` gets each batch's counts.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        # Written once to the shared folder for its several uses, which survives lost executors.
        # Its files give Spark the exact size for its join choice, and the ids' range to skip stored files by.
        batch = materialise(batch, "arrivals")
        lo, hi = batch.agg(F.min("id"), F.max("id")).first()
        result = insert_if_absent(batch, path, keys, None if lo is None else (lo, hi))
        if on_result is not None:
            on_result(batch_id, result)

    return _started(messages, sink, checkpoint, "append", drain)


def ingest_with_rejects(
    lines: DataFrame,
    good: Callable[[DataFrame, int], dict],
    rejects: str,
    checkpoint: str,
    on_result: Callable[[int, dict], None] | None = None,
    drain: bool = False,
) -> StreamingQuery:
    """One stream of landed lines, two sinks in one micro-batch.

    ``lines`` is ``adapters.landing_and_rejects``. Readable payloads go to ``good(payloads,
    batch_id)``, which must be replay-safe itself (``insert_if_absent`` is, by key); unreadable
    lines are written to ``rejects/_batch=<id>``, which a replayed batch overwrites, so a
    reject is stored once. ``on_result`` gets the good sink's counts with ``rejected`` added.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        # Stored once in the shared folder: both sinks read it, a lost executor loses nothing.
        batch = materialise(batch, "landed-lines")
        bad = batch.where("bad").select("file", "record")
        bad.write.mode("overwrite").parquet(f"{rejects}/_batch={batch_id}")
        result = good(batch.where(~F.col("bad")).select("payload.*").drop("_corrupt_record"), batch_id) or {}
        result = {**result, "rejected": bad.count()}
        if on_result is not None:
            on_result(batch_id, result)

    return _started(lines, sink, checkpoint, "append", drain)


def running_markers(messages: DataFrame) -> DataFrame:
    """Oldest / newest per ticker as running state, one row per ticker."""
    return marker_state(messages)


def keep_latest(state: DataFrame, path: str, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Write each update round of a running aggregate as its own version.

    Versions are told apart by ``_batch``; a replayed round overwrites itself.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")

    return _started(state, sink, checkpoint, "update", drain)


def track_markers(messages: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
    """Keep the running markers only as the stream's state; rounds write no output.

    Read them with ``markers_from_state`` at any time between rounds.
    """
    writer = marker_state(messages).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def markers_from_state(spark, checkpoint: str) -> DataFrame:
    """The running markers as the state store holds them after the last committed round.

    Spark's state data source reads the aggregation's state of the latest batch: the key is the
    ticker, the value the aggregate's buffers in order (count, least oldest-marker, least
    newest-marker). One row per ticker, as many tasks as state partitions; no folder per round.
    """
    state = spark.read.format("statestore").load(checkpoint)
    buffers = state.schema["value"].dataType.fields
    # Both minima are named ``min``: a cast to a struct of new names renames them by position.
    named = T.StructType([T.StructField(name, f.dataType, f.nullable) for name, f in zip(("n", "oldest", "newest"), buffers)])
    flat = state.select("key.ticker", F.col("value").cast(named).alias("v")).select("ticker", "v.*")
    return flat.selectExpr("ticker", *_RESULT, "n")


def latest_markers(versions: DataFrame) -> DataFrame:
    """The most recent state of every ticker among the written versions."""
    newest = F.max_by(F.struct("oldest_id", "oldest_at", "newest_id", "newest_at", "n"), "_batch")
    return versions.groupBy("ticker").agg(newest.alias("s")).select("ticker", "s.*")


def live_sentiment(messages: DataFrame, width: str = "1 hour", late_by: str = "1 hour") -> DataFrame:
    """Bullish share per ticker and tumbling window on a forward stream.

    Rows later than ``late_by`` behind the newest seen are dropped and a window is
    final once the watermark passes it. Use ``back_filled_sentiment`` for streams
    that run backward in time.
    """
    return _windowed(messages.withWatermark("created_at", late_by), width)


def window_accounting(spark, query: StreamingQuery, rows: str, checkpoint: str) -> dict:
    """Where every input row of a finished ``live_sentiment`` stream went.

    ``emitted``: rows in windows the watermark closed and the sink holds (sum of their ``n``);
    ``open``: rows in windows still in the state store (read with the state data source);
    ``late_groups``: what the watermark dropped, from the query's progress; Spark counts the
    stateful operator's input there, which is partial aggregates (one per task, ticker and
    window), so the late rows are the labelled input less ``emitted`` and ``open``, and at least
    ``late_groups``. Progress is kept for the last
    ``spark.sql.streaming.numRecentProgressUpdates`` rounds; if earlier rounds are gone this
    refuses rather than undercount.
    """
    progress = query.recentProgress
    if progress and progress[0]["batchId"] != 0:
        raise RuntimeError("the progress of early rounds is no longer held; raise numRecentProgressUpdates")
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p["stateOperators"])
    emitted = spark.read.parquet(rows).agg(F.sum("n")).first()[0] or 0
    state = spark.read.format("statestore").load(checkpoint)
    buffers = state.schema["value"].dataType.fields
    named = T.StructType([T.StructField(name, f.dataType, f.nullable) for name, f in zip(("sum", "count", "n"), buffers)])
    still = state.select(F.col("value").cast(named).alias("v")).agg(F.sum("v.n")).first()[0] or 0
    return {"emitted": int(emitted), "open": int(still), "late_groups": int(late)}


def back_filled_sentiment(messages: DataFrame, width: str = "1 hour") -> DataFrame:
    """The same without a watermark, for update or complete mode; no row is late."""
    return _windowed(messages, width)


def _windowed(messages: DataFrame, width: str) -> DataFrame:
    return (
        labelled(messages)
        .groupBy("ticker", F.window("created_at", width).alias("w"))
        .agg(F.avg("sentiment").alias("bullish_ratio"), F.count(F.lit(1)).alias("n"))
        .select("ticker", F.col("w.start").alias("hour"), hour_label(F.col("w.start")).alias("label"), "bullish_ratio", "n")
    )
