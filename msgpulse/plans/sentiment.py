"""Sentiment over time, markers, tallies: queries on the event messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.functions.labels import null_to_sentinel, sentinel_to_null
from msgpulse.functions.times import from_epoch, parse_time
from msgpulse.operators import aggregates, filters, keyed, markers, migrate, ranking, series
from msgpulse.plans.catalogue import query
from msgpulse.plans.inputs import EV_COLUMNS_SQL, EV_SQL, LOG_SQL, PRICES_SQL, event_messages, event_prices, fetch_log, table
from msgpulse.schema import RECORD_COLUMNS, STORE_COLUMNS, conform, in_order
from msgpulse.session import materialise, scratch_path

_DAILY_SQL = """daily AS (
    SELECT ticker, CAST(created_at AS DATE) AS day, avg(sentiment) AS bullish_ratio, count(*) AS n
    FROM ev WHERE sentiment <> -69 GROUP BY 1, 2)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- aggregates ---------------------------------------------------------------------


@query(
    "a1_daily_sentiment",
    f"WITH {EV_SQL}, {_DAILY_SQL} SELECT ticker, day, round(bullish_ratio, 6) AS bullish_ratio, n FROM daily",
)
def daily(spark, sf):
    return _rounded(aggregates.daily_sentiment(event_messages(spark, sf)), "bullish_ratio")


@query(
    "a2_hourly_sentiment",
    f"""WITH {EV_SQL} SELECT ticker, date_trunc('hour', created_at) AS hour,
        strftime(date_trunc('hour', created_at), '%m/%d %H') AS label,
        round(avg(sentiment), 6) AS bullish_ratio, count(*) AS n
        FROM ev WHERE sentiment <> -69 AND created_at >= '2024-01-05' AND created_at < '2024-01-20'
        GROUP BY 1, 2, 3""",
)
def hourly(spark, sf):
    found = aggregates.hourly_sentiment(event_messages(spark, sf), "2024-01-05", "2024-01-20")
    return _rounded(found, "bullish_ratio")


@query(
    "a3_class_histogram",
    f"WITH {EV_SQL} SELECT sentiment, count(*) AS n FROM ev WHERE sentiment IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1",
)
def histogram(spark, sf):
    return aggregates.class_histogram(event_messages(spark, sf))


@query("a4_store_counts", f"WITH {EV_SQL} SELECT ticker, count(*) AS n, grouping(ticker) = 1 AS is_total FROM ev GROUP BY ROLLUP (ticker)")
def store_counts(spark, sf):
    return aggregates.store_counts(event_messages(spark, sf))


_MARKERS_SQL = """marks AS (
    SELECT ticker, min_by(id, (created_at, CAST(id AS BIGINT))) AS oldest_id, min(created_at) AS oldest_at,
           max_by(id, (created_at, -CAST(id AS BIGINT))) AS newest_id, max(created_at) AS newest_at, count(*) AS n
    FROM {rows} GROUP BY ticker HAVING count(*) > 1)"""


@query("a6_ticker_markers", f"WITH {EV_SQL}, {_MARKERS_SQL.format(rows='ev')} SELECT * FROM marks")
def ticker_markers(spark, sf):
    return markers.ticker_markers(event_messages(spark, sf))


_TEXT_IDS_SQL = """ids AS (SELECT * REPLACE (CASE WHEN likes % 3 = 0 THEN 'k' || id ELSE id END AS id) FROM ev)"""


def _text_ids(spark, sf):
    """Every third id is text."""
    id_ = F.when(F.col("likes") % 3 == 0, F.concat(F.lit("k"), "id")).otherwise(F.col("id"))
    return event_messages(spark, sf).withColumn("id", id_)


_ORDERED_SQL = """marks AS (
    SELECT ticker, min_by(id, (created_at, CASE WHEN id LIKE 'k%' THEN 1 ELSE 0 END, length(id), id)) AS oldest_id,
           min(created_at) AS oldest_at,
           min_by(id, (-epoch_us(created_at), CASE WHEN id LIKE 'k%' THEN 1 ELSE 0 END, length(id), id)) AS newest_id,
           max(created_at) AS newest_at, CAST(count(*) AS BIGINT) AS n
    FROM {rows} GROUP BY ticker HAVING count(*) > 1)"""


@query("a6_text_ids", f"WITH {EV_SQL}, {_TEXT_IDS_SQL}, {_ORDERED_SQL.format(rows='ids')} SELECT * FROM marks")
def text_id_markers(spark, sf):
    return markers.ticker_markers(_text_ids(spark, sf))


@query(
    "f10_text_ids",
    f"""WITH {EV_SQL}, {_TEXT_IDS_SQL}, part AS (SELECT * FROM ids WHERE created_at < '2024-01-16'),
        {_ORDERED_SQL.format(rows='part')}
        SELECT ids.id, ids.ticker FROM ids LEFT JOIN marks ON ids.ticker = marks.ticker
        WHERE marks.ticker IS NULL OR CASE WHEN ids.id NOT LIKE 'k%' AND newest_id NOT LIKE 'k%'
            THEN TRY_CAST(ids.id AS BIGINT) > TRY_CAST(newest_id AS BIGINT)
            ELSE (length(ids.id), ids.id) > (length(newest_id), newest_id) END""",
)
def text_id_cursor(spark, sf):
    messages = _text_ids(spark, sf)
    stored = materialise(markers.ticker_markers(messages.where("created_at < '2024-01-16'")), "markers")
    return markers.beyond_cursor(messages, stored, markers.FORWARD).select("id", "ticker")


@query(
    "a5_markers_size_guard",
    f"""WITH {EV_SQL}, per AS (SELECT substr(id, 1, length(id) - 1) AS ticker, id, created_at FROM ev),
        {_MARKERS_SQL.format(rows='per')} SELECT * FROM marks""",
)
def guarded_markers(spark, sf):
    """Groups of ids that share all but the last digit; the first ten ids are groups of one digit less."""
    tens = F.expr("substring(id, 1, length(id) - 1)")
    return markers.ticker_markers(event_messages(spark, sf).withColumn("ticker", tens))


@query(
    "a8_fetch_tally",
    f"""WITH {LOG_SQL} SELECT CASE WHEN status = 200 AND n_rows = 0 THEN 'no_new_rows' WHEN status = 200 THEN 'ok'
        WHEN status IN (429, 403) THEN 'rate_limited' ELSE 'error ' || status END AS outcome, count(*) AS n
        FROM fetches GROUP BY 1""",
)
def fetch_tally(spark, sf):
    return aggregates.fetch_tally(fetch_log(spark, sf))


@query(
    "a11_migration_parity",
    f"""WITH {EV_SQL}
        SELECT ticker, CAST(count(*) FILTER (sentiment = -69) AS BIGINT) AS sentinels_before,
               CAST(count(*) FILTER (nullif(sentiment, -69) IS NULL) AS BIGINT) AS nulls_after, true AS same
        FROM ev GROUP BY ticker""",
)
def migration_parity(spark, sf):
    """Both tables as stored, the old one with NULL labels of its own."""
    return aggregates.migration_parity(*_migrated_tables(spark, sf))


def _migrated_tables(spark, sf):
    old_path, new_path = scratch_path(spark, "old"), scratch_path(spark, "new")
    event_messages(spark, sf).write.parquet(old_path)
    return migrate.migrate_table(spark, old_path, new_path)


@query(
    "a12_class_sizes",
    f"""WITH {EV_SQL} SELECT count(*) FILTER (sentiment = 1) AS n_bull, count(*) FILTER (sentiment = 0) AS n_bear,
        CAST(floor(count(*) FILTER (sentiment = 0) * 0.75) AS BIGINT) AS sample_size FROM ev""",
)
def class_sizes(spark, sf):
    return aggregates.class_sizes(event_messages(spark, sf))


# --- filters ------------------------------------------------------------------------


@query("f1_labelled_store_rows", f"WITH {EV_SQL} SELECT id, sentiment FROM ev WHERE sentiment <> -69")
def labelled_sql(spark, sf):
    return event_messages(spark, sf).where("sentiment <> -69").select("id", "sentiment")


@query(
    "f2_labelled_rows",
    f"WITH {EV_SQL} SELECT id, sentiment, source FROM ev WHERE sentiment <> -69 AND sentiment IS NOT NULL",
)
def labelled(spark, sf):
    return filters.labelled(event_messages(spark, sf)).select("id", "sentiment", "source")


@query("f3_unlabelled_rows", f"WITH {EV_SQL} SELECT id, sentiment FROM ev WHERE sentiment IS NULL OR sentiment = -69")
def unlabelled(spark, sf):
    return filters.unlabelled(event_messages(spark, sf), include_uncertain=True).select("id", "sentiment")


@query(
    "f4_time_range",
    f"WITH {EV_SQL} SELECT id, created_at FROM ev WHERE created_at >= '2024-01-10' AND created_at < '2024-01-13'",
)
def time_range(spark, sf):
    return filters.created_between(event_messages(spark, sf), "2024-01-10", "2024-01-13").select("id", "created_at")


@query(
    "f8_not_null_gate",
    f"""WITH {EV_SQL}, holes AS (SELECT id, CASE WHEN likes % 7 <> 0 THEN body END AS body, created_at, source,
        CASE WHEN likes % 5 <> 0 THEN author END AS author FROM ev)
        SELECT id, body, author, created_at, source FROM holes WHERE body IS NOT NULL AND author IS NOT NULL""",
)
def not_null_gate(spark, sf):
    holes = event_messages(spark, sf).withColumns(
        {"body": F.when(F.col("likes") % 7 != 0, F.col("body")), "author": F.when(F.col("likes") % 5 != 0, F.col("author"))}
    )
    return filters.valid(holes).select("id", "body", "author", "created_at", "source")


@query(
    "f9_last_day",
    f"""WITH {EV_SQL} SELECT id, created_at FROM ev
        WHERE created_at >= TIMESTAMP '2024-01-19 12:00:00' AND created_at <= TIMESTAMP '2024-01-20 12:00:00'""",
)
def last_day(spark, sf):
    return filters.within_last_day(event_messages(spark, sf), "2024-01-20 12:00:00").select("id", "created_at")


def _cursor_sql(side: str, op: str, bounds: str) -> str:
    return f"""WITH {EV_SQL}, part AS (SELECT * FROM ev WHERE {bounds}), {_MARKERS_SQL.format(rows='part')}
        SELECT ev.id, ev.ticker FROM ev LEFT JOIN marks ON ev.ticker = marks.ticker
        WHERE marks.ticker IS NULL OR CAST(ev.id AS BIGINT) {op} CAST(marks.{side}_id AS BIGINT)"""


@query("f10_cursor_backward", _cursor_sql("oldest", "<", "created_at >= '2024-01-16'"))
def cursor_backward(spark, sf):
    messages = event_messages(spark, sf)
    stored = materialise(markers.ticker_markers(messages.where("created_at >= '2024-01-16'")), "markers")
    return markers.beyond_cursor(messages, stored, markers.BACKWARD).select("id", "ticker")


@query("f10_cursor_forward", _cursor_sql("newest", ">", "created_at < '2024-01-16'"))
def cursor_forward(spark, sf):
    messages = event_messages(spark, sf)
    stored = materialise(markers.ticker_markers(messages.where("created_at < '2024-01-16'")), "markers")
    return markers.beyond_cursor(messages, stored, markers.FORWARD).select("id", "ticker")


@query("f11_successful_fetches", f"WITH {LOG_SQL} SELECT ticker, fetched_at, n_rows FROM fetches WHERE status = 200")
def successful_fetches(spark, sf):
    return filters.succeeded(fetch_log(spark, sf)).select("ticker", "fetched_at", "n_rows")


# --- look-ups -----------------------------------------------------------------------


@query(
    "j6_marker_lookup",
    f"""WITH {EV_SQL}, {_MARKERS_SQL.format(rows='ev')}
        SELECT ev.id, ev.ticker, oldest_id, oldest_at, newest_id, newest_at FROM ev LEFT JOIN marks USING (ticker)""",
)
def marker_lookup(spark, sf):
    messages = event_messages(spark, sf)
    stored = materialise(markers.ticker_markers(messages), "markers")
    return keyed_markers(messages, stored)


def keyed_markers(messages: DataFrame, stored: DataFrame) -> DataFrame:
    joined = markers.with_markers(messages.select("id", "ticker"), stored)
    return joined.select("id", "ticker", "oldest_id", "oldest_at", "newest_id", "newest_at")


@query(
    "j7_cashtag_mentions",
    f"""WITH {EV_SQL}, listed AS (SELECT DISTINCT ticker FROM ev WHERE sentiment = 1)
        SELECT id, body, regexp_extract(body, '\\$([A-Za-z][A-Za-z.]*)', 1) AS mention FROM ev
        WHERE regexp_extract(body, '\\$([A-Za-z][A-Za-z.]*)', 1) IN (SELECT ticker FROM listed)""",
)
def cashtag_mentions(spark, sf):
    messages = event_messages(spark, sf)
    listed = messages.where("sentiment = 1").select("ticker").distinct()
    return keyed.ticker_mentions(messages.select("id", "body"), materialise(listed, "tickers")).select("id", "body", "mention")


# --- order and top rows -------------------------------------------------------------


@query("t1_oldest_message", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev ORDER BY created_at, id LIMIT 1")
def oldest(spark, sf):
    return markers.oldest(event_messages(spark, sf))


@query("t1_newest_message", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev ORDER BY created_at DESC, id LIMIT 1")
def newest(spark, sf):
    return markers.newest(event_messages(spark, sf))


@query(
    "t3_top_per_ticker",
    f"""WITH {EV_SQL} SELECT id, ticker, likes, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY likes DESC, id) AS rank FROM ev) WHERE rank <= 100""",
)
def top_per_ticker(spark, sf):
    best = ranking.top_per_group(event_messages(spark, sf), ["ticker"], [F.desc("likes"), F.asc("id")], 100)
    return best.select("id", "ticker", "likes", "rank")


@query(
    "t4_histogram_order",
    f"WITH {EV_SQL} SELECT source, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, source",
)
def source_histogram(spark, sf):
    return aggregates.class_histogram(event_messages(spark, sf), "source")


@query(
    "t5_time_ordered_series",
    f"WITH {EV_SQL}, {_DAILY_SQL} SELECT ticker, day, round(bullish_ratio, 6) AS bullish_ratio, n FROM daily ORDER BY 1, 2",
)
def ordered_series(spark, sf):
    return _rounded(aggregates.in_time_order(aggregates.daily_sentiment(event_messages(spark, sf)), "day"), "bullish_ratio")


@query(
    "m1_sampled_tickers",
    f"WITH {EV_SQL} SELECT ticker FROM (SELECT DISTINCT author AS ticker FROM ev) ORDER BY md5('round-1' || ticker), ticker LIMIT 100",
)
def sampled_tickers(spark, sf):
    return ranking.sample_tickers(event_messages(spark, sf).select(F.col("author").alias("ticker")), 100)


# --- projections --------------------------------------------------------------------


@query("p6_record_columns", f"WITH {EV_SQL} SELECT {', '.join(RECORD_COLUMNS)} FROM ev")
def record_columns(spark, sf):
    return in_order(event_messages(spark, sf), RECORD_COLUMNS)


@query("p7_parse_time", "SELECT event_id, date_trunc('second', ts) AS created_at FROM events")
def parsed_time(spark, sf):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "events").select("event_id", parse_time(text).alias("created_at"))


@query("p8_epoch_seconds", "SELECT event_id, make_timestamp(CAST(epoch(ts) AS BIGINT) * 1000000) AS created_at FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def epoch_time(spark, sf):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", from_epoch(seconds).alias("created_at"))


@query(
    "p9_nested_defaults",
    """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS likes,
       coalesce(CAST(json_extract_string(props, '$.replies') AS BIGINT), 0) AS replies,
       coalesce(json_extract_string(props, '$.user.id'), '') AS author FROM events""",
)
def nested_defaults(spark, sf):
    nested = F.from_json("props", "k BIGINT, replies BIGINT, user STRUCT<id: STRING>")
    return table(spark, sf, "events").withColumn("p", nested).select(
        "event_id",
        F.coalesce("p.k", F.lit(0)).cast("bigint").alias("likes"),
        F.coalesce("p.replies", F.lit(0)).cast("bigint").alias("replies"),
        F.coalesce("p.user.id", F.lit("")).alias("author"),
    )


@query(
    "p12_sentinel_codec",
    f"WITH {EV_SQL} SELECT id, nullif(sentiment, -69) AS as_null, coalesce(sentiment, -69) AS as_code FROM ev",
)
def sentinel_codec(spark, sf):
    return event_messages(spark, sf).select(
        "id",
        sentinel_to_null(F.col("sentiment")).alias("as_null"),
        null_to_sentinel(F.col("sentiment")).alias("as_code"),
    )


@query(
    "p17_time_buckets",
    f"""WITH {EV_SQL} SELECT id, CAST(created_at AS DATE) AS day, date_trunc('hour', created_at) AS hour,
        strftime(created_at, '%m/%d %H') AS label FROM ev""",
)
def time_buckets(spark, sf):
    from msgpulse.functions.times import day_of, hour_label, hour_of

    at = F.col("created_at")
    return event_messages(spark, sf).select("id", day_of(at).alias("day"), hour_of(at).alias("hour"), hour_label(at).alias("label"))


# --- schema maintenance -------------------------------------------------------------


@query("e1_conformed_table", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS body, CAST(user_id AS VARCHAR) AS author, ts AS created_at, CAST(NULL AS INTEGER) AS sentiment, 'Twitter' AS source, CAST(0 AS BIGINT) AS likes, CAST(0 AS BIGINT) AS replies, CAST(NULL AS VARCHAR) AS ticker FROM events")
def conformed(spark, sf):
    return conform(
        table(spark, sf, "events").select(
            F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.col("user_id").alias("author"), F.lit("Twitter").alias("source")
        )
    )


@query("e2_migrated_table", f"WITH {EV_SQL} SELECT * REPLACE (nullif(sentiment, -69) AS sentiment) FROM ev")
def migrated(spark, sf):
    """The old table in another column order, the new one as written and read back."""
    old_path = scratch_path(spark, "old-layout")
    event_messages(spark, sf).select("ticker", *reversed(STORE_COLUMNS)).write.parquet(old_path)
    return migrate.migrate_table(spark, old_path, scratch_path(spark, "new-layout"))[1]


@query(
    "e3_sentinels_to_null",
    f"WITH {EV_SQL} SELECT ticker, count(*) FILTER (nullif(sentiment, -69) IS NULL) AS n_null, count(*) AS n FROM ev GROUP BY 1",
)
def sentinels_to_null(spark, sf):
    return (
        migrate.migrated(event_messages(spark, sf))
        .groupBy("ticker")
        .agg(F.count_if(F.col("sentiment").isNull()).alias("n_null"), F.count(F.lit(1)).alias("n"))
    )


# --- roadmap ------------------------------------------------------------------------


@query(
    "d1_quarter_hour_sentiment",
    f"""WITH {EV_SQL} SELECT ticker, time_bucket(INTERVAL 15 MINUTE, created_at) AS bucket,
        round(avg(sentiment), 6) AS bullish_ratio, count(*) AS n FROM ev WHERE sentiment <> -69 GROUP BY 1, 2""",
)
def quarter_hours(spark, sf):
    return _rounded(aggregates.bucketed_sentiment(event_messages(spark, sf), 15), "bullish_ratio")


@query(
    "d2_hourly_archive",
    f"""WITH {EV_SQL} SELECT ticker, date_trunc('hour', created_at) AS hour, round(avg(sentiment), 6) AS bullish_ratio,
        count(*) AS n, CAST(created_at AS DATE) AS day FROM ev WHERE sentiment <> -69 GROUP BY 1, 2, 5""",
)
def hourly_archive(spark: SparkSession, sf):
    from msgpulse.sources.sinks import archive_hourly

    path = scratch_path(spark, "hourly")
    archive_hourly(aggregates.hourly_sentiment(event_messages(spark, sf)), path)
    return _rounded(spark.read.parquet(path), "bullish_ratio").select("ticker", "hour", "bullish_ratio", "n", "day")


@query(
    "d3_relative_sentiment",
    f"""WITH {EV_SQL}, {_DAILY_SQL}, framed AS (
        SELECT *, avg(bullish_ratio) OVER w AS base, stddev_samp(bullish_ratio) OVER w AS spread FROM daily
        WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
        SELECT ticker, day, round(bullish_ratio, 6) AS bullish_ratio, n,
               round(CASE WHEN spread > 0 THEN (bullish_ratio - base) / spread END, 6) AS relative FROM framed""",
)
def relative(spark, sf):
    return _rounded(series.relative_sentiment(event_messages(spark, sf)), "bullish_ratio", "relative")


@query(
    "d4_price_correlation",
    f"""WITH {EV_SQL}, {_DAILY_SQL}, {PRICES_SQL} SELECT ticker, round(corr(bullish_ratio, close), 6) AS correlation,
        count(*) AS n_days FROM daily JOIN prices USING (ticker, day) GROUP BY 1""",
)
def price_correlation(spark, sf):
    daily_rows = aggregates.daily_sentiment(event_messages(spark, sf))
    return _rounded(series.price_correlation(daily_rows, event_prices(spark, sf)), "correlation")


@query(
    "d4_next_day_correlation",
    f"""WITH {EV_SQL}, {_DAILY_SQL}, {PRICES_SQL},
        trading AS (SELECT * FROM prices WHERE dayofweek(day) NOT IN (0, 6)),
        later AS (SELECT ticker, day, lead(close) OVER (PARTITION BY ticker ORDER BY day) AS close FROM trading)
        SELECT ticker, round(corr(bullish_ratio, close), 6) AS correlation, count(*) AS n_days
        FROM daily JOIN later USING (ticker, day) WHERE close IS NOT NULL GROUP BY 1""",
)
def next_day_correlation(spark, sf):
    """With the close of the next trading day; weekends have no prices."""
    daily_rows = aggregates.daily_sentiment(event_messages(spark, sf))
    trading = event_prices(spark, sf).where(~F.dayofweek("day").isin(1, 7))
    return _rounded(series.price_correlation(daily_rows, trading, lag_days=1), "correlation")
