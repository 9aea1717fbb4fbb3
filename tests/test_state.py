"""Running markers read from the stream's state store: many rounds, no output folders."""

import os

from msgpulse.operators.markers import marker_state
from msgpulse.plans.inputs import messages_of_events, table
from msgpulse.session import local_form, scratch_path
from msgpulse.streaming import feeds


def test_markers_from_state_after_many_rounds(spark, sf):
    out = scratch_path(spark, "state-test")
    events = table(spark, sf, "events")
    events.repartition(10).write.parquet(f"{out}/landed")
    landed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/landed")
    query = feeds.track_markers(messages_of_events(landed), f"{out}/at", drain=True)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 8
    got = sorted(tuple(r) for r in feeds.markers_from_state(spark, f"{out}/at").collect())
    want = sorted(tuple(r) for r in marker_state(messages_of_events(events)).collect())
    assert got == want
    assert not [n for n in os.listdir(local_form(out)) if n.startswith("_batch")]


def test_state_between_rounds_is_the_state_so_far(spark, sf):
    out = scratch_path(spark, "state-rounds")
    events = table(spark, sf, "events")
    first, second = events.where("ts < '2024-01-15'"), events.where("ts >= '2024-01-15'")
    first.write.parquet(f"{out}/landed/a")
    stream = lambda: messages_of_events(spark.readStream.schema(events.schema).parquet(f"{out}/landed/*"))
    feeds.track_markers(stream(), f"{out}/at", drain=True).awaitTermination()
    early = sorted(tuple(r) for r in feeds.markers_from_state(spark, f"{out}/at").collect())
    assert early == sorted(tuple(r) for r in marker_state(messages_of_events(first)).collect())
    second.write.parquet(f"{out}/landed/b")
    feeds.track_markers(stream(), f"{out}/at", drain=True).awaitTermination()
    late = sorted(tuple(r) for r in feeds.markers_from_state(spark, f"{out}/at").collect())
    assert late == sorted(tuple(r) for r in marker_state(messages_of_events(events)).collect())
