"""Golden cases of the message operators, one per peculiarity of the data."""

import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from msgpulse.functions import hashing, labels, text, times
from msgpulse.operators import aggregates, combine, dedup, filters, keyed, markers, migrate, ranking, series
from msgpulse.schema import CSV_COLUMNS, MESSAGE_COLUMNS, RECORD_COLUMNS, STORE_COLUMNS, conform, in_order


def ids(df):
    return sorted(r.id for r in df.collect())


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


def test_labelled_drops_null_and_uncertain(golden):
    assert ids(filters.labelled(golden)) == ["1", "1", "2", "5"]


def test_unlabelled_with_and_without_uncertain(golden):
    assert ids(filters.unlabelled(golden)) == ["4"]
    assert ids(filters.unlabelled(golden, include_uncertain=True)) == ["3", "4"]


def test_upper_bound_midnight_is_excluded(golden):
    assert ids(filters.created_between(golden, "2020-12-27", "2020-12-30")) == ["1", "3", "4", "5"]


def test_not_null_gate_counts_what_it_drops(golden):
    seen = Observation()
    assert ids(filters.valid(golden, seen)) == ["1", "1", "2", "3", "4"]
    assert seen.get == {"seen": 6, "rejected": 1}


def test_daily_sentiment_excludes_uncertain(golden):
    rows = aggregates.daily_sentiment(golden).orderBy("day").collect()
    assert [(r.ticker, str(r.day), r.bullish_ratio, r.n) for r in rows] == [
        ("AAPL", "2020-12-29", 1.0, 2),
        ("AAPL", "2020-12-30", 0.0, 1),
        ("AAPL", "2020-12-31", 0.0, 1),
    ]


def test_hourly_label_and_range(golden):
    rows = aggregates.hourly_sentiment(golden, "2020-12-27", "2020-12-30").orderBy("hour").collect()
    assert [(r.label, r.n) for r in rows] == [("12/29 12", 1), ("12/29 23", 1)]


def test_minute_buckets(golden):
    rows = aggregates.bucketed_sentiment(golden, 30).orderBy("bucket").collect()
    assert rows[1].bucket == dt.datetime(2020, 12, 29, 23, 30)


def test_histogram_order_and_missing(golden):
    rows = aggregates.class_histogram(golden).collect()
    assert [(r.sentiment, r.n) for r in rows] == [(0, 2), (1, 2), (-69, 1)]


def test_store_counts_have_a_total(golden):
    rows = {(r.ticker, r.is_total): r.n for r in aggregates.store_counts(golden).collect()}
    assert rows == {("AAPL", False): 5, ("MSFT", False): 1, (None, True): 6}


def test_single_row_tickers_have_no_markers(golden):
    assert [r.ticker for r in markers.ticker_markers(golden).collect()] == ["AAPL"]
    assert sorted(r.ticker for r in markers.ticker_markers(golden, min_rows=1).collect()) == ["AAPL", "MSFT"]


def test_marker_ties_go_to_the_smallest_id(spark):
    rows = [("A", i, t) for i, t in [("30", 5), ("4", 5), ("200", 9), ("70", 9), ("1", 7)]]
    messages = spark.createDataFrame(rows, "ticker string, id string, s long").select(
        "ticker", "id", F.timestamp_seconds("s").alias("created_at")
    )
    numeric = markers.ticker_markers(messages).first()
    assert (numeric.oldest_id, numeric.newest_id, numeric.n) == ("4", "70", 5)
    as_text = markers.ticker_markers(messages.withColumn("id", F.concat(F.lit("k"), "id"))).first()
    assert (as_text.oldest_id, as_text.newest_id, as_text.n) == ("k4", "k70", 5)


def test_text_ids_take_part_in_markers_and_pass_the_cursor(spark):
    rows = [("A", "10", 1), ("A", "20", 2), ("A", "k3x8", 3), ("A", "k3x9", 4), ("A", None, 9), ("B", "k1", 1), ("B", None, 2)]
    messages = spark.createDataFrame(rows, "ticker string, id string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    found = markers.ticker_markers(messages).collect()
    assert [(r.ticker, r.oldest_id, r.newest_id, r.n) for r in found] == [("A", "10", "k3x9", 4)]
    known = spark.createDataFrame([("A", "20", "20")], "ticker string, oldest_id string, newest_id string")
    assert {r.id for r in markers.beyond_cursor(messages.where("ticker = 'A'"), known, markers.FORWARD).collect()} == {"k3x8", "k3x9", None}


def test_messages_without_body_are_no_copies(spark):
    rows = [(str(k), None if k < 10 else "same", k) for k in range(12)]
    messages = spark.createDataFrame(rows, "id string, body string, s long").withColumn("created_at", F.timestamp_seconds("s"))
    assert {r.id for r in dedup.first_message_per_text(messages).collect()} == {str(k) for k in range(11)}


def test_markers_before_1970_and_with_negative_ids(spark):
    messages = spark.createDataFrame([("A", "-5", -100), ("A", "7", -100), ("A", "9", -50)], "ticker string, id string, s long")
    found = markers.ticker_markers(messages.withColumn("created_at", F.timestamp_seconds("s"))).first()
    assert (found.oldest_id, found.newest_id) == ("-5", "9")


def test_cursor_directions_compare_numbers(spark):
    rows = spark.createDataFrame([("9", "A"), ("10", "A"), ("11", "A"), ("5", "B")], "id string, ticker string")
    known = spark.createDataFrame([("A", "10", "10")], "ticker string, oldest_id string, newest_id string")
    assert ids(markers.beyond_cursor(rows, known, markers.BACKWARD)) == ["5", "9"]
    assert ids(markers.beyond_cursor(rows, known, markers.FORWARD)) == ["11", "5"]
    assert markers.beyond_cursor(rows, known, markers.NONE).count() == 4


def test_oldest_and_newest(golden):
    assert markers.oldest(golden).first().id == "3"
    assert markers.newest(golden).first().body == "later copy"


def test_first_copy_survives(golden):
    kept = dedup.first_message_per_id(golden).where("id = '1'").collect()
    assert [r.body for r in kept] == ["up we go"]
    by_source = dedup.first_message_per_id(golden, F.col("author") != "u9").where("id = '1'").collect()
    assert [r.body for r in by_source] == ["later copy"]


def test_url_stripping(spark):
    def stripped(s):
        return one(spark, body=s).select(text.strip_urls(F.col("body"))).first()[0]

    assert stripped("see http://x.y/z now") == "see  now"
    assert stripped("see http://x.y/z\u00a0now") == "see \u00a0now"
    assert stripped("https://a") == ""
    assert stripped("http") == "http"
    assert stripped("a http://b\u3000c https://d\x1ee") == "a \u3000c \x1ee"


def test_phrases_are_literal_and_case_sensitive(spark):
    bodies = ["was (delayed) again", "delayed again", "[delayed quote", "a.b", "axb", "NEWS", "fine", None]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    found = filters.matching_phrases(rows, ["(delayed)", "[delayed", "a.b", "news"])
    assert sorted(r.body for r in found.collect()) == ["[delayed quote", "a.b", "was (delayed) again"]
    folded = filters.matching_phrases(rows, ["News"], ignore_case=True)
    assert [r.body for r in folded.collect()] == ["NEWS"]
    assert filters.matching_phrases(rows, []).count() == 0


def test_cashtags(spark):
    row = one(spark, body="buy $BRK.B. and $aapl, $aapl not $5").select(text.cashtags(F.col("body")).alias("t")).first()
    assert row.t == ["BRK.B", "AAPL"]


def test_mentions_join_listed_tickers_only(spark):
    messages = spark.createDataFrame([("1", "$A $b $zz"), ("2", "none")], "id string, body string")
    listed = spark.createDataFrame([("a",), ("B",), ("B",)], "ticker string")
    found = keyed.ticker_mentions(messages, listed).collect()
    assert sorted((r.id, r.mention) for r in found) == [("1", "A"), ("1", "B")]


def test_timestamps_are_utc(spark):
    row = spark.range(1).select(
        times.parse_time(F.lit("2021-01-01T10:00:00+02:00")).alias("a"),
        times.parse_time(F.lit("2021-01-01T10:00:00Z")).alias("b"),
        times.parse_time(F.lit("nonsense")).alias("c"),
        times.from_epoch(F.lit(1609459200.5)).alias("d"),
    )
    got = row.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.S").alias(c) for c in "abcd"]).first()
    assert tuple(got) == ("2021-01-01 08:00:00.0", "2021-01-01 10:00:00.0", None, "2021-01-01 00:00:00.5")


def test_score_means(spark):
    rows = [(["0.05"], 1), (["0.04"], -69), (["-0.05"], 0), (["-0.3", "0.1"], 0), ([], None), (None, None)]
    frame = spark.createDataFrame(rows, "scores array<string>, wanted int")
    mean = labels.mean_score(F.col("scores"))
    for r in frame.select("wanted", labels.sentiment_of_mean(mean).alias("got")).collect():
        assert r.got == r.wanted


def test_pairs(spark):
    rows = [(0.0, 0.0, -69), (0.1, 0.0004, -69), (0.1003, 0.0, 0), (-2.0, 3.0, 1), (1000.0, -1000.0, 0), (-1000.0, 1000.0, 1)]
    frame = spark.createDataFrame(rows, "a double, b double, wanted int")
    pair = labels.softmax_pair(F.col("a"), F.col("b"))
    for r in frame.select("wanted", pair.alias("p"), labels.sentiment_of_pair(pair[0], pair[1]).alias("got")).collect():
        assert r.got == r.wanted
        assert abs(sum(r.p) - 1) < 1e-12


def test_codecs(spark):
    rows = spark.createDataFrame([(1,), (0,), (-69,), (None,), (-1,)], "s int")
    got = rows.select(
        labels.sentinel_to_null(F.col("s")).alias("n"),
        labels.null_to_sentinel(F.col("s")).alias("c"),
        labels.remap_legacy(F.col("s")).alias("r"),
    ).collect()
    assert [r.n for r in got] == [1, 0, None, None, -1]
    assert [r.c for r in got] == [1, 0, -69, -69, -1]
    assert [r.r for r in got] == [1, 0, -69, None, 0]


def test_column_orders(golden):
    for order in (STORE_COLUMNS, CSV_COLUMNS, RECORD_COLUMNS):
        assert in_order(golden, order).columns == order


def test_conform_matches_by_name_and_fills_defaults(spark):
    raw = spark.createDataFrame([(7, "2021-01-01 00:00:00", 3)], "id long, created_at string, other int")
    row = conform(raw).first()
    assert conform(raw).columns == MESSAGE_COLUMNS
    assert (row.id, row.likes, row.replies, row.body, row.created_at.year) == ("7", 0, 0, None, 2021)


def test_missing_text_stays_null(spark):
    raw = spark.createDataFrame([("1", None)], "id string, body string")
    assert combine.consolidated(raw).first().body is None


def test_union_aligns_by_name(spark):
    a = spark.createDataFrame([("1", 5)], "id string, likes long")
    b = spark.createDataFrame([("x", "2")], "body string, id string")
    rows = {r.id: (r.body, r.likes) for r in combine.union_by_name(a, b).collect()}
    assert rows == {"1": (None, 5), "2": ("x", None)}


def test_flag_overlay_spam_wins(spark):
    rows = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    spam = spark.createDataFrame([("1",), ("2",), ("2",), ("absent",)], "id string")
    ham = spark.createDataFrame([("2",), ("3",), ("3",)], "id string")
    got = {r.id: r.is_spam for r in keyed.overlay_spam_flags(rows, spam, ham).collect()}
    assert got == {"1": 1, "2": 1, "3": 0, "4": None}
    assert keyed.unmatched_ids(spam, rows).first().n_unmatched == 1


def test_predictions_never_replace_stored_labels(spark):
    rows = spark.createDataFrame([("1", 1), ("2", None), ("3", None)], "id string, sentiment int")
    predicted = spark.createDataFrame(
        [("1", 0, "v1"), ("2", 0, "v1"), ("2", -69, "v2")], "id string, sentiment int, model_version string"
    )
    got = {r.id: r.sentiment for r in keyed.with_predictions(rows, predicted).collect()}
    assert got == {"1": 1, "2": -69, "3": None}


def test_absent_keys_include_those_without_ticker(spark):
    batch = spark.createDataFrame([("A", "1"), ("B", "1"), (None, "1"), (None, "2")], "ticker string, id string")
    target = spark.createDataFrame([("A", "1"), (None, "1"), (None, "1")], "ticker string, id string")
    got = keyed.absent_from(batch, target).collect()
    assert sorted((r.ticker or "", r.id) for r in got) == [("", "2"), ("B", "1")]


def test_migration_keeps_parity(golden):
    old = golden.where("sentiment IS NOT NULL")
    rows = aggregates.migration_parity(old, migrate.migrated(old)).collect()
    assert [(r.ticker, r.sentinels_before, r.nulls_after, r.same) for r in rows] == [("AAPL", 1, 1, True)]
    mixed = aggregates.migration_parity(golden, migrate.migrated(golden)).where("ticker = 'MSFT'").first()
    assert mixed.same and mixed.nulls_after == 1


def test_fetch_outcomes(spark):
    log = spark.createDataFrame([(200, 3), (200, 0), (429, 0), (403, 0), (500, 0), (500, 0)], "status int, n_rows long")
    got = {r.outcome: r.n for r in aggregates.fetch_tally(log).collect()}
    assert got == {"ok": 1, "no_new_rows": 1, "rate_limited": 2, "error 500": 2}
    assert filters.succeeded(log).count() == 2


def test_sampled_tickers_never_exceed_the_list(spark):
    tickers = spark.createDataFrame([(f"T{i}",) for i in range(30)] * 2, "ticker string")
    assert ranking.sample_tickers(tickers, 200).count() == 30
    first, second = (ranking.sample_tickers(tickers, 10, salt).collect() for salt in ("a", "b"))
    assert len({r.ticker for r in first}) == 10 and first != second


def test_shuffle_is_a_reproducible_permutation(golden):
    once, again = (ids_in_order(ranking.shuffled(golden)) for _ in range(2))
    assert once == again and sorted(once) == ids(golden)


def ids_in_order(df):
    return [r.id for r in df.collect()]


def test_surrogate_ids_separate_fields(spark):
    row = spark.range(1).select(
        hashing.surrogate_id(F.lit("ab"), F.lit("c")).alias("a"), hashing.surrogate_id(F.lit("a"), F.lit("bc")).alias("b")
    ).first()
    assert row.a != row.b


def test_relative_sentiment_uses_preceding_days_only(spark):
    days = [("A", f"2021-01-{d:02d} 10:00:00", s, i) for d in range(1, 5) for i, s in enumerate([1, d % 2])]
    rows = conform(
        spark.createDataFrame(days, "ticker string, created_at string, sentiment int, i int").withColumn("id", F.uuid())
    )
    got = [r.relative for r in series.relative_sentiment(rows).orderBy("day").collect()]
    assert got[:2] == [None, None]
    # Days 1 to 3 are 1.0, 0.5, 1.0; day 4 is 0.5.
    assert abs(got[3] - (0.5 - 2.5 / 3) / (1 / 12) ** 0.5) < 1e-9


def test_correlation_with_lag_counts_observed_days(spark):
    """Friday, Monday and Tuesday meet the closes of Monday, Tuesday and Wednesday."""
    days = [dt.date(2021, 1, d) for d in (1, 4, 5, 6)]
    daily = spark.createDataFrame(list(zip("AAA", days, (0.1, 0.5, 0.9))), "ticker string, day date, bullish_ratio double")
    prices = spark.createDataFrame(list(zip("AAAA", days, (7.0, 1.0, 5.0, 9.0))), "ticker string, day date, close double")
    got = series.price_correlation(daily, prices, lag_days=1).first()
    assert got.n_days == 3 and abs(got.correlation - 1) < 1e-9


def test_hot_groups_give_exact_results(spark):
    """A third of all rows in one ticker, one text and one id, spread over many tasks."""
    rows = spark.range(0, 6000, 1, 300).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 50)).alias("ticker"),
        F.when(F.col("id") % 3 == 0, "copied").otherwise(F.concat(F.lit("b"), F.col("id") % 900)).alias("body"),
        (F.col("id") * 7919 % 1009).alias("likes"),
        F.timestamp_seconds(F.col("id") * 31 % 5003).alias("created_at"),
        F.lit("u").alias("author"),
        F.lit(1).alias("sentiment"),
    )
    local = rows.toPandas()
    best = ranking.top_per_group(rows, ["ticker"], [F.desc("likes"), F.asc("id")], 100).toPandas()
    wanted = local.sort_values(["likes", "id"], ascending=[False, True]).groupby("ticker").head(100)
    assert sorted(best["id"]) == sorted(wanted["id"])
    assert sorted(best[best.ticker == "HOT"]["rank"]) == list(range(1, 101))

    kept = dedup.first_message_per_text(rows).toPandas()
    wanted = local.sort_values(["created_at", "id"]).groupby("body").head(1)
    assert sorted(kept["id"]) == sorted(wanted["id"])

    hot_id = rows.withColumn("id", F.when(F.col("ticker") == "HOT", "same").otherwise(F.col("id")))
    kept = {r.id: r.likes for r in dedup.first_message_per_id(hot_id).collect()}
    first = local[local.ticker == "HOT"].sort_values(["created_at"]).iloc[0]
    assert len(kept) == 4001 and kept["same"] == first["likes"]
