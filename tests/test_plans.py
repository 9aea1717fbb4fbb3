"""The physical plans have the intended shape."""

import re

import pytest
from pyspark.sql import functions as F

from msgpulse import plans
from msgpulse.operators import aggregates, dedup, keyed, markers, ranking, sampling, series
from msgpulse.plans.inputs import event_messages
from msgpulse.session import materialise
from msgpulse.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark, sf):
    return event_messages(spark, sf)


@pytest.fixture(scope="module")
def stored(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "messages")
    sinks.write_parquet(events, path)
    return sinks.read_messages(spark, path)


def test_daily_sentiment_is_two_hash_aggregates_over_a_pruned_scan(stored):
    text = plan(aggregates.daily_sentiment(stored))
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text and text.count("Exchange") == 1
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "partial_avg" in text and set(pushed.split(", ")) == {"IsNotNull(sentiment)", "Not(EqualTo(sentiment,-69))"}
    assert re.search(r"ReadSchema: struct<created_at:timestamp,sentiment:int>", text)


def test_one_ticker_reads_one_partition(stored):
    text = plan(stored.where("ticker = 'C'").select("id"))
    assert "PartitionFilters: [isnotnull(ticker" in text


def test_time_range_reaches_the_scan(stored):
    assert "GreaterThanOrEqual(created_at" in plan(aggregates.hourly_sentiment(stored, "2024-01-05", "2024-01-06"))


def test_numeric_markers_are_hash_aggregates(stored):
    """Only text ids, and one row of either kind per ticker, are reduced by sorting."""
    text = plan(markers.ticker_markers(stored))
    assert text.count("HashAggregate") == 2 and text.count("SortAggregate") == 4 and text.count("FileScan") == 2
    narrow = re.findall(r"ReadSchema: (\S+)", text)
    assert len(narrow) == 2 and not any("body" in columns for columns in narrow)


def test_dedup_is_cut_before_its_only_shuffle(stored):
    text = plan(dedup.first_message_per_id(stored))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_top_rows_are_cut_before_both_rounds_of_shuffle(stored):
    text = plan(ranking.top_per_group(stored, ["ticker"], [F.desc("likes"), F.asc("id")]))
    assert text.count("WindowGroupLimit") == 4 and len(re.findall(r"Exchange hash", text)) == 2
    assert re.search(r"Exchange hashpartitioning\(ticker#\d+, _share#\d+", text)


def test_text_dedup_keeps_bodies_out_of_the_grouping(stored):
    text = plan(dedup.first_message_per_text(stored))
    grouped = re.search(r"Exchange hashpartitioning\(_text.*?FileScan.*?ReadSchema: (\S+)", text, re.S)
    assert "WindowGroupLimit" in text and grouped and "author" not in grouped.group(1)


def test_id_range_reaches_the_scan(stored):
    text = plan(sinks.new_rows(stored.limit(3), stored, id_range=("100", "2")))
    assert "GreaterThanOrEqual(id,100), LessThanOrEqual(id,2)" in text


def test_first_rows_do_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan(markers.oldest(stored))
    assert "TakeOrderedAndProject" in plan(ranking.sample_tickers(stored, 5))


def test_insert_broadcasts_the_batch_and_prunes_the_target(stored):
    text = plan(sinks.new_rows(stored.where("ticker = 'C' AND likes > 90"), stored))
    assert "LeftSemi, BuildRight" in text and "dynamicpruning" in text and "SortMergeJoin" not in text


def test_large_batches_shuffle_instead(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        text = plan(sinks.new_rows(stored, stored))
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_balanced_sample_ranks_only_the_cut_cell(stored):
    text = plan(sampling.balanced_sample(stored))
    # The only whole-table inputs of the windows are the histogram and the joined cut cell.
    assert text.count("FileScan") == 3
    assert len(re.findall(r"ReadSchema: struct<id:string,sentiment:int>", text)) == 2
    assert "SortMergeJoin" not in text


def test_hash_split_does_not_shuffle(stored):
    assert "Exchange" not in plan(sampling.spam_split(stored))


def test_cursor_and_mentions_leave_messages_in_place(stored):
    known = materialise(markers.ticker_markers(stored), "markers")
    assert "Exchange hashpartitioning" not in plan(markers.beyond_cursor(stored, known, markers.FORWARD))
    text = plan(keyed.ticker_mentions(stored, materialise(stored.select("ticker").distinct(), "tickers")))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_relative_series_windows_run_on_daily_rows(stored):
    text = plan(series.relative_sentiment(stored))
    assert text.index("Window") < text.index("HashAggregate")


ML_OR_STREAM = re.compile(r"^(l[2-7]|k6|r\d|s11|x3|s2|x4)_")


@pytest.mark.parametrize("name", [n for n in sorted(plans.queries()) if not ML_OR_STREAM.match(n)])
def test_no_cross_joins_and_no_python_in_query_plans(spark, sf, name):
    text = plan(plans.queries()[name](spark, sf))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in text
