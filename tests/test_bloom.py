"""Bloom filters on stored ids: a small insert reads only the row groups that may hold its ids."""

from pyspark.sql import functions as F

from msgpulse.plans.inputs import event_messages
from msgpulse.schema import MESSAGE_COLUMNS
from msgpulse.session import scratch_path
from msgpulse.sources import sinks


def scanned_rows(df) -> int:
    """Rows the Parquet scans of an executed query produced (row groups skipped are not read)."""
    df.collect()
    total = 0

    def walk(node):
        nonlocal total
        if "Scan" in node.nodeName() and node.metrics().contains("numOutputRows"):
            total += node.metrics().get("numOutputRows").get().value()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next())

    walk(df._jdf.queryExecution().executedPlan())
    return total


def synthetic(spark, n):
    return spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"),
        F.lit("body").alias("body"),
        F.lit("u").alias("author"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("id"))).alias("created_at"),
        F.lit(1).alias("sentiment"),
        F.lit("StockTwits").alias("source"),
        F.lit(0).cast("bigint").alias("likes"),
        F.lit(0).cast("bigint").alias("replies"),
        F.when(F.col("id") % 10 == 0, "BBB").otherwise("AAA").alias("ticker"),
    )


def test_probe_skips_row_groups(spark):
    path = scratch_path(spark, "bloom")
    messages = synthetic(spark, 100_000)
    sinks.write_parquet(messages.coalesce(1), path, row_group_bytes=128 * 1024)
    stored = sinks.read_messages(spark, path)
    asked = [(r.ticker, r.id) for r in messages.where(F.col("id").isin([]) | (F.rand(3) < 0.0002)).collect()]
    asked = [(t, i) for t, i in asked if t == "AAA"][:5] + [("AAA", "no-such-id")]
    probe = sinks.probed(stored, asked)
    read = scanned_rows(probe)
    assert probe.count() == len(asked) - 1
    assert read < 0.5 * 90_000, read  # most row groups of the ticker are skipped
    assert "PushedFilters: [Or(" in probe._jdf.queryExecution().executedPlan().toString() or read < 90_000


def test_small_batches_store_what_the_join_stores(spark, sf):
    messages = event_messages(spark, sf)
    part = F.abs(F.hash("id")) % 5
    paths = {}
    for limit in (0, 1000):
        path = paths[limit] = scratch_path(spark, "bloom-insert")
        probed = []
        for k in range(5):
            batch = messages.where(part <= k)  # each batch repeats the earlier ones
            probed.append(sinks.insert_if_absent(batch, path, probe_limit=limit)["probed"])
        assert all(probed) == (limit > 0 and messages.count() <= limit)
    rows = [sorted(tuple(r) for r in sinks.read_messages(spark, p).select(*MESSAGE_COLUMNS).collect()) for p in paths.values()]
    assert rows[0] == rows[1] and len(rows[0]) > 0


def test_probe_with_repeated_and_missing_keys(spark):
    path = scratch_path(spark, "bloom-odd")
    base = synthetic(spark, 50)
    sinks.insert_if_absent(base, path)
    again = base.unionByName(base).unionByName(base.limit(3).withColumn("ticker", F.lit(None).cast("string")))
    got = sinks.insert_if_absent(again, path)
    assert not got["probed"]  # a missing ticker takes the join
    got = sinks.insert_if_absent(base.unionByName(base), path)
    assert got["probed"] and got["inserted"] == 0
    assert sinks.read_messages(spark, path).where(F.col("ticker").isNotNull()).count() == 50
