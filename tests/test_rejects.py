"""Unreadable payload lines: counted in batch, routed to their own sink in a stream, stored once on replay."""

import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from msgpulse.session import local_form, scratch_path
from msgpulse.sources import adapters, sinks
from msgpulse.streaming import feeds

LINES = [
    '{"ticker":"AAA","messages":[{"id":1,"body":"up","created_at":"2024-01-02T10:00:00Z","user":{"id":"u"}}]}',
    '{"ticker":"AAA","messages":[{"id":2,"body":"dow',  # cut short
    '{"ticker":"BBB","messages":[{"id":3,"body":"flat","created_at":"2024-01-02T11:00:00Z","user":{"id":"v"}}]}',
    "not json at all",
    "",
]


def land(spark, files=3):
    path = scratch_path(spark, "landed")
    spark.createDataFrame([(line,) for line in LINES * files], "value STRING").repartition(files).write.text(path)
    return path


def test_batch_counts_what_it_cannot_read(spark):
    path = land(spark)
    counts = Observation()
    good = adapters.counted_landed(spark, "stocktwits", path, counts)
    assert good.count() == 6
    assert counts.get == {"lines": 12, "rejected": 6}
    plain_good, plain_bad = adapters.landed_and_rejects(spark, "stocktwits", path)
    assert plain_good.count() == 6 and plain_bad.count() == 6


def test_stream_sends_rejects_to_their_sink_and_messages_to_the_table(spark):
    path, out = land(spark), scratch_path(spark, "stream-rejects")
    results = {}

    def good(payloads, batch_id):
        return sinks.insert_if_absent(adapters.stocktwits_messages(payloads), f"{out}/messages")

    lines = adapters.landing_and_rejects(spark, "stocktwits", path, files_per_trigger=1)
    feeds.ingest_with_rejects(lines, good, f"{out}/rejects", f"{out}/at", results.__setitem__, drain=True).awaitTermination()
    assert sum(r["rejected"] for r in results.values()) == 6
    assert sum(r["inserted"] for r in results.values()) == 2  # ids 1 and 3, once each
    assert spark.read.parquet(f"{out}/rejects").count() == 6
    assert sinks.read_messages(spark, f"{out}/messages").count() == 2

    # A replayed batch: drop the last commit, start again; rejects and rows are stored once.
    commits = local_form(f"{out}/at/commits")
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    os.remove(os.path.join(commits, last))
    if os.path.exists(os.path.join(commits, f".{last}.crc")):
        os.remove(os.path.join(commits, f".{last}.crc"))
    feeds.ingest_with_rejects(lines, good, f"{out}/rejects", f"{out}/at", results.__setitem__, drain=True).awaitTermination()
    assert spark.read.parquet(f"{out}/rejects").count() == 6
    assert sinks.read_messages(spark, f"{out}/messages").count() == 2
    assert spark.read.parquet(f"{out}/rejects").where(F.col("record").contains("dow")).count() == 3
