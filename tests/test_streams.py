"""A stream over many files equals the batch result; replays change nothing."""

import pytest
from pyspark.sql import functions as F

from msgpulse.operators import aggregates, markers
from msgpulse.plans.inputs import event_messages
from msgpulse.schema import MESSAGE_SCHEMA
from msgpulse.sources import adapters, sinks
from msgpulse.streaming import feeds


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def messages(spark, sf):
    return event_messages(spark, sf)


@pytest.fixture(scope="module")
def unordered(messages, tmp_path_factory):
    """Files in no time order, as a back-fill brings them."""
    path = str(tmp_path_factory.mktemp("unordered") / "files")
    messages.repartition(6, F.md5("id")).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def ordered(messages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ordered") / "files")
    for lo, hi in (("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2024-02-02")):
        messages.where(f"created_at >= '{lo}' AND created_at < '{hi}'").coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, path):
    return spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_of_unordered_files_loses_nothing(spark, messages, unordered, tmp_path):
    results = []
    run = lambda at: feeds.ingest(
        stream(spark, unordered), str(tmp_path / "t"), str(tmp_path / at), on_result=lambda i, r: results.append(r), drain=True
    ).awaitTermination()
    run("at")
    assert rows(sinks.read_messages(spark, str(tmp_path / "t"))) == rows(messages)
    assert sum(r["inserted"] for r in results) == messages.count() and len(results) == 6
    # A new checkpoint replays every file.
    results.clear()
    run("again")
    assert {r["status"] for r in results} == {"no_new_rows"}
    assert sinks.read_messages(spark, str(tmp_path / "t")).count() == messages.count()


def test_resume_reads_only_new_files(spark, messages, tmp_path):
    seen = []
    for i in range(2):
        messages.where(f"CAST(id AS INT) % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))
        feeds.ingest(
            stream(spark, str(tmp_path / "landed")), str(tmp_path / "t"), str(tmp_path / "at"),
            on_result=lambda b, r: seen.append(r["seen"]), drain=True,
        ).awaitTermination()
    assert sum(seen) == messages.count()
    assert rows(sinks.read_messages(spark, str(tmp_path / "t"))) == rows(messages)


def test_running_markers_equal_batch(spark, messages, unordered, tmp_path):
    state = feeds.running_markers(stream(spark, unordered))
    feeds.keep_latest(state, str(tmp_path / "v"), str(tmp_path / "at"), drain=True).awaitTermination()
    got = feeds.latest_markers(spark.read.parquet(str(tmp_path / "v")))
    assert rows(got) == rows(markers.ticker_markers(messages, min_rows=1))


def collect_rounds(spark, frame, tmp_path, mode):
    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/rounds/round={batch_id}")

    writer = frame.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{tmp_path}/at")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/rounds").drop("round")


def test_closed_live_hours_equal_batch(spark, messages, ordered, tmp_path):
    got = collect_rounds(spark, feeds.live_sentiment(stream(spark, ordered)), tmp_path, "append")
    closed = F.col("hour") + F.expr("INTERVAL 2 HOURS") <= F.lit(messages.agg(F.max("created_at")).first()[0])
    wanted = aggregates.hourly_sentiment(messages).where(closed).select(*got.columns)
    assert got.count() > 100 and rows(got) == rows(wanted)


def test_late_rows_are_dropped_by_the_watermark_only(spark, tmp_path):
    def land(i, *times):
        messages = [(f"{i}-{t}", t, 1, "A") for t in times]
        frame = spark.createDataFrame(messages, "id string, t string, sentiment int, ticker string")
        frame = frame.select("id", F.to_timestamp("t").alias("created_at"), "sentiment", "ticker")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "landed"))

    land(1, "2024-01-01 00:10:00", "2024-01-01 09:00:00")
    watermarked, plain = str(tmp_path / "w"), str(tmp_path / "p")
    for _ in range(2):
        source = lambda: spark.readStream.schema("id string, created_at timestamp, sentiment int, ticker string").parquet(
            str(tmp_path / "landed")
        )
        collect_rounds(spark, feeds.live_sentiment(source()), watermarked, "append")
        collect_rounds(spark, feeds.back_filled_sentiment(source()), plain, "update")
        land(2, "2024-01-01 00:20:00", "2024-01-01 12:00:00")
    live = spark.read.parquet(f"{watermarked}/rounds").where("hour = '2024-01-01 00:00:00'").collect()
    assert [r.n for r in live] == [1]
    full = spark.read.parquet(f"{plain}/rounds").where("hour = '2024-01-01 00:00:00'").collect()
    assert max(r.n for r in full) == 2


def test_callback_sees_every_row_once(spark, messages, unordered, tmp_path):
    seen = []
    feeds.for_each_batch(stream(spark, unordered), lambda b, i: seen.append(b.count()), str(tmp_path / "at"), drain=True).awaitTermination()
    assert sum(seen) == messages.count() and len(seen) == 6


def test_landing_stream_equals_landed_batch(spark, tmp_path):
    posts = spark.range(50).select(
        F.lit("submission").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("t").alias("title"),
        F.struct(F.lit("n").alias("name")).alias("author"), F.lit(1.6e9).alias("created_utc"), F.lit("stocks").alias("subreddit"),
    )
    posts.repartition(3).write.json(str(tmp_path / "landed"))
    arriving = adapters.reddit_messages(adapters.landing(spark, "reddit", str(tmp_path / "landed"), files_per_trigger=1))
    feeds.ingest(arriving, str(tmp_path / "t"), str(tmp_path / "at"), drain=True).awaitTermination()
    batch = adapters.reddit_messages(adapters.landed(spark, "reddit", str(tmp_path / "landed")))
    assert rows(sinks.read_messages(spark, str(tmp_path / "t"))) == rows(batch)
