"""Feed adapters on landed payloads, and the streaming crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.functions.text import cashtags
from msgpulse.operators import aggregates, keyed
from msgpulse.operators.filters import labelled
from msgpulse.operators.markers import FORWARD, beyond_cursor, ticker_markers
from msgpulse.plans.catalogue import SQL, query
from msgpulse.plans.inputs import EV_COLUMNS_SQL, EV_SQL, FIRST_MINUTE, event_messages, letter, messages_of_events, table
from msgpulse.schema import CSV_COLUMNS, RECORD_COLUMNS
from msgpulse.session import materialise, scratch_path
from msgpulse.sources import adapters, sinks
from msgpulse.streaming import feeds

# --- landed payloads made from the given tables ---------------------------------------


def _land_stocktwits(spark: SparkSession, sf: str) -> str:
    """Each event as a payload of two messages: a full one and one lacking every optional field."""
    path = scratch_path(spark, "stocktwits")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.concat(F.lit("$"), letter(F.col("user_id")), F.lit(" "), F.col("event_type"))
    full = F.to_json(
        F.struct(
            F.col("event_id").alias("id"),
            body.alias("body"),
            at.alias("created_at"),
            F.struct(F.col("user_id").alias("id")).alias("user"),
            F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("total")).alias("likes"),
            F.struct((F.col("user_id") % 4).alias("replies")).alias("conversation"),
        )
    )
    bare = F.to_json(
        F.struct((-F.col("event_id") - 1).alias("id"), F.lit("bare").alias("body"), at.alias("created_at"))
    )
    entities = (
        F.when(F.col("event_type").isin("purchase", "signup"), '{"sentiment":{"basic":"Bullish"}}')
        .when(F.col("event_type") == "error", '{"sentiment":{"basic":"Bearish"}}')
        .when(F.col("event_type") == "click", '{"sentiment":null}')
        .otherwise('{"sentiment":{"basic":"Other"}}')
    )
    line = F.concat(
        F.lit('{"ticker":"'),
        letter(F.col("user_id")),
        F.lit('","messages":['),
        F.regexp_replace(full, r"\}$", ',"entities":'),
        entities,
        F.lit("},"),
        F.regexp_replace(bare, r"\}$", ',"entities":{}}'),
        F.lit("]}"),
    )
    table(spark, sf, "events").select(line).write.text(path)
    return path


def _stocktwits_sql(other: str, missing: str) -> str:
    return f"""SELECT CAST(event_id AS VARCHAR) AS id, '$' || chr(CAST(65 + user_id % 20 AS INTEGER)) || ' ' || event_type AS body,
        CAST(user_id AS VARCHAR) AS author, ts AS created_at,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN 0
             WHEN event_type = 'view' THEN {other} END AS sentiment,
        'StockTwits' AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS likes, user_id % 4 AS replies,
        chr(CAST(65 + user_id % 20 AS INTEGER)) AS ticker FROM events
        UNION ALL SELECT CAST(-event_id - 1 AS VARCHAR), 'bare', '', ts, {missing}, 'StockTwits', 0, 0,
        chr(CAST(65 + user_id % 20 AS INTEGER)) FROM events"""


def _land_twitter(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "twitter")
    at = F.date_format(
        F.timestamp_seconds(F.col("doc_id") * 60 + FIRST_MINUTE) + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"
    )
    tweet = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.col("text"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("author_id"),
        F.concat(at, F.lit("+02:00")).alias("created_at"),
        F.col("lang"),
        F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("like_count")).alias("public_metrics"),
    )
    table(spark, sf, "documents").select(F.to_json(F.struct(F.array(tweet).alias("data")))).write.text(path)
    return path


_TWITTER_SQL = """SELECT CAST(doc_id AS VARCHAR) AS id, text AS body, CASE WHEN doc_id % 5 <> 0 THEN source ELSE '' END AS author,
    make_timestamp(1704067200000000 + doc_id * 60000000) AS created_at, CAST(NULL AS INTEGER) AS sentiment, 'Twitter' AS source,
    CASE WHEN doc_id % 3 <> 0 THEN n_chars ELSE 0 END AS likes, CAST(0 AS BIGINT) AS replies, CAST(NULL AS VARCHAR) AS ticker
    FROM documents WHERE lang = 'en' AND contains(text, '$')"""


def _land_reddit(spark: SparkSession, sf: str) -> str:
    """Conversation turns as posts of three communities and one outside; user turns are submissions."""
    path = scratch_path(spark, "reddit")
    conv = F.col("conv_id")
    community = F.when(conv % 4 == 0, "stocks").when(conv % 4 == 1, "wallstreetbets").when(conv % 4 == 2, "investing")
    posts = table(spark, sf, "conversations").select(
        F.when(F.col("turn") % 3 == 1, "comment").otherwise("submission").alias("kind"),
        F.concat_ws("-", conv, "turn").alias("id"),
        F.when(F.col("turn") % 4 != 2, F.concat("role", F.lit(": "))).alias("title"),
        F.col("text").alias("selftext"),
        F.struct(F.col("role").alias("name")).alias("author"),
        (F.lit(FIRST_MINUTE) + conv % 2880 * 60 + F.col("turn")).cast("double").alias("created_utc"),
        F.col("turn").alias("score"),
        (conv % 7).alias("num_comments"),
        community.otherwise("gardening").alias("subreddit"),
        ((conv * 31 + F.col("turn") * 7) % 97 / 97).alias("relevance"),
    )
    posts.write.json(path)
    return path


_REDDIT_SQL = """posts AS (
    SELECT conv_id || '-' || turn AS id,
           CASE WHEN turn % 4 <> 2 THEN role || ': ' ELSE '' END || text AS body, role AS author,
           make_timestamp((1704067200 + conv_id % 2880 * 60 + turn) * 1000000) AS created_at,
           CAST(NULL AS INTEGER) AS sentiment, 'Reddit' AS source, turn AS likes, conv_id % 7 AS replies,
           (conv_id * 31 + turn * 7) % 97 / 97 AS relevance
    FROM conversations WHERE turn % 3 <> 1 AND conv_id % 4 <> 3)"""


# --- adapters ---------------------------------------------------------------------------


@query("s8_stocktwits_feed", _stocktwits_sql("NULL", "NULL"))
def stocktwits_feed(spark, sf):
    raw = adapters.landed(spark, "stocktwits", _land_stocktwits(spark, sf))
    return adapters.stocktwits_messages(raw)


@query(
    "s8_rejected_payloads",
    """SELECT '{"ticker":"' || chr(CAST(65 + user_id % 20 AS INTEGER)) || '","messages":[{"id":' || event_id
              || CASE WHEN event_id % 7 = 0 THEN '' ELSE '}]}' END AS record, event_id % 7 = 0 AS rejected FROM events""",
)
def rejected_payloads(spark, sf):
    """Payload lines cut short come back as rejects; every other line is read."""
    path = scratch_path(spark, "payloads")
    record = F.concat(
        F.lit('{"ticker":"'), letter(F.col("user_id")), F.lit('","messages":[{"id":'), F.col("event_id").cast("string")
    )
    whole = F.concat(record, F.lit("}]}"))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, record).otherwise(whole)).write.text(path)
    good, bad = adapters.landed_and_rejects(spark, "stocktwits", path)
    read = good.select("ticker", F.explode("messages.id").alias("id")).select(
        F.concat(F.lit('{"ticker":"'), "ticker", F.lit('","messages":[{"id":'), F.col("id").cast("string"), F.lit("}]}")).alias("record"),
        F.lit(False).alias("rejected"),
    )
    return read.unionByName(bad.select("record", F.lit(True).alias("rejected")))


def _land_cut_short(spark, sf):
    """Stocktwits payload lines of the events; every seventh is cut short."""
    path = scratch_path(spark, "payloads")
    record = F.concat(
        F.lit('{"ticker":"'), letter(F.col("user_id")), F.lit('","messages":[{"id":'), F.col("event_id").cast("string")
    )
    whole = F.concat(record, F.lit("}]}"))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 0, record).otherwise(whole)).write.text(path)
    return path


def _as_records(payloads):
    return payloads.select("ticker", F.explode("messages.id").alias("id")).select(
        F.concat(F.lit('{"ticker":"'), "ticker", F.lit('","messages":[{"id":'), F.col("id").cast("string"), F.lit("}]}")).alias("record"),
        F.lit(False).alias("rejected"),
    )


@query("s8_rejects_stream", SQL["s8_rejected_payloads"])
def rejects_stream(spark, sf):
    """The same lines as a stream: readable ones and rejects leave one micro-batch by two sinks."""
    out = scratch_path(spark, "landed-stream")

    def good(payloads, batch_id):
        payloads.write.mode("overwrite").parquet(f"{out}/good/_batch={batch_id}")  # a replay overwrites itself
        return {}

    lines = adapters.landing_and_rejects(spark, "stocktwits", _land_cut_short(spark, sf), files_per_trigger=4)
    feeds.ingest_with_rejects(lines, good, f"{out}/rejects", f"{out}/at", drain=True).awaitTermination()
    payloads = spark.read.schema(f"{adapters.PAYLOADS['stocktwits']}, _batch BIGINT").parquet(f"{out}/good")
    bad = spark.read.schema("file STRING, record STRING, _batch BIGINT").parquet(f"{out}/rejects")
    return _as_records(payloads).unionByName(bad.select("record", F.lit(True).alias("rejected")))


@query("p2_strict_labels", _stocktwits_sql("0", "0"))
def strict_labels(spark, sf):
    """The compatibility decoding: only an explicit null is unlabelled."""
    raw = adapters.landed(spark, "stocktwits_strict", _land_stocktwits(spark, sf))
    return adapters.stocktwits_messages(raw, strict_compat=True)


@query("p1_stocktwits_records", f"SELECT id, author, likes, replies, ticker FROM ({_stocktwits_sql('NULL', 'NULL')})")
def stocktwits_records(spark, sf):
    raw = adapters.landed(spark, "stocktwits", _land_stocktwits(spark, sf))
    return adapters.stocktwits_messages(raw).select("id", "author", "likes", "replies", "ticker")


@query("s9_twitter_feed", _TWITTER_SQL)
def twitter_feed(spark, sf):
    return adapters.twitter_messages(adapters.landed(spark, "twitter", _land_twitter(spark, sf)))


_MENTIONS_SQL = """posts AS (
        SELECT conv_id || '-' || turn AS id, '$' || chr(CAST(65 + conv_id % 20 AS INTEGER)) || ' $'
               || lower(chr(CAST(65 + turn % 20 AS INTEGER))) || '. $ZZZ ' || coalesce(text, '') AS body,
               make_timestamp(1704067200000000 + conv_id % 2880 * 60000000) AS created_at
        FROM conversations),
    named AS (
        SELECT DISTINCT id, body, created_at, upper(rtrim(unnest(regexp_extract_all(body, '\\$([A-Za-z][A-Za-z.]*)', 1)), '.')) AS ticker
        FROM posts)"""


def _land_mentions(spark: SparkSession, sf: str) -> str:
    """Turns of conversations as posts with a listed or unlisted, a lower-case and an unknown cashtag."""
    path = scratch_path(spark, "mentions")
    conv, turn = F.col("conv_id"), F.col("turn")
    body = F.concat(F.lit("$"), letter(conv), F.lit(" $"), F.lower(letter(turn)), F.lit(". $ZZZ "), F.coalesce("text", F.lit("")))
    post = F.struct(
        F.concat_ws("-", conv, turn).alias("id"),
        body.alias("text"),
        F.date_format(F.timestamp_seconds(conv % 2880 * 60 + FIRST_MINUTE), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lit("en").alias("lang"),
    )
    table(spark, sf, "conversations").select(F.to_json(F.struct(F.array(post).alias("data")))).write.text(path)
    return path


def _first_letters(spark, sf):
    """Ten listed tickers, from the given events."""
    found = table(spark, sf, "events").select(letter(F.col("user_id")).alias("ticker")).distinct()
    return materialise(found.where("ticker < 'K'"), "tickers")


@query(
    "s9_twitter_search",
    f"""WITH {_MENTIONS_SQL} SELECT id, ticker, md5(body) AS body_md5, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY created_at DESC, id) AS rank FROM named
        WHERE ticker IN (SELECT chr(CAST(65 + user_id % 20 AS INTEGER)) FROM events) AND ticker < 'K') WHERE rank <= 100""",
)
def twitter_search(spark, sf):
    raw = adapters.landed(spark, "twitter", _land_mentions(spark, sf))
    found = adapters.twitter_search(raw, _first_letters(spark, sf))
    return found.select("id", "ticker", F.md5("body").alias("body_md5"), "rank")


@query(
    "j7_several_mentions",
    f"""WITH {_MENTIONS_SQL} SELECT id, ticker FROM named
        WHERE ticker IN (SELECT chr(CAST(65 + user_id % 20 AS INTEGER)) FROM events) AND ticker < 'K'""",
)
def several_mentions(spark, sf):
    """Posts with several cashtags meet the list; unlisted ones are no rows."""
    raw = adapters.landed(spark, "twitter", _land_mentions(spark, sf))
    posts = adapters.twitter_messages(raw).select("id", "body")
    return keyed.ticker_mentions(posts, _first_letters(spark, sf)).select("id", F.col("mention").alias("ticker"))


@query("p3_twitter_records", f"SELECT id, author, created_at, likes FROM ({_TWITTER_SQL})")
def twitter_records(spark, sf):
    raw = adapters.landed(spark, "twitter", _land_twitter(spark, sf))
    return adapters.twitter_messages(raw).select("id", "author", "created_at", "likes")


@query("p4_reddit_submissions", f"WITH {_REDDIT_SQL} SELECT {', '.join(CSV_COLUMNS)} FROM posts")
def reddit_submissions(spark, sf):
    raw = adapters.landed(spark, "reddit", _land_reddit(spark, sf))
    return adapters.reddit_messages(raw).select(*CSV_COLUMNS)


@query(
    "p5_record_kinds",
    """SELECT CASE WHEN turn % 3 = 1 THEN 'comment' ELSE 'submission' END AS kind, count(*) AS landed,
       count(*) FILTER (turn % 3 <> 1 AND conv_id % 4 <> 3) AS converted FROM conversations GROUP BY 1""",
)
def record_kinds(spark, sf):
    """How many posts of each kind have a message form."""
    raw = adapters.landed(spark, "reddit", _land_reddit(spark, sf))
    converted = adapters.reddit_messages(raw).select("id", F.lit(1).alias("_converted"))
    return (
        raw.select("id", "kind")
        .join(converted, "id", "left")
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("landed"), F.count("_converted").alias("converted"))
    )


@query(
    "s10_reddit_search",
    f"""WITH {_REDDIT_SQL}, words AS (
        SELECT DISTINCT upper(rtrim(w, '.')) AS ticker FROM (
            SELECT unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z.]*)', 1)) AS w FROM benchmark)),
        named AS (SELECT DISTINCT id, likes, created_at, relevance, upper(rtrim(w, '.')) AS ticker FROM (
            SELECT *, unnest(regexp_extract_all(body, '([A-Za-z][A-Za-z.]*)', 1)) AS w FROM posts
            WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00' AND created_at <= TIMESTAMP '2024-01-02 01:00:00'))
        SELECT id, ticker, likes, created_at, relevance, CAST(rank AS INTEGER) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY relevance DESC, id) AS rank
            FROM named JOIN words USING (ticker)) WHERE rank <= 100""",
)
def reddit_search(spark, sf):
    """One day of submissions that name a word of the benchmark texts, best 100 per word."""
    raw = adapters.landed(spark, "reddit", _land_reddit(spark, sf))
    words = table(spark, sf, "benchmark").select(F.explode(cashtags(F.col("text"), adapters.WORD_PATTERN)).alias("ticker"))
    listed = words.distinct()
    found = adapters.reddit_search(raw, materialise(listed, "words"), "2024-01-02 01:00:00")
    return found.select("id", "ticker", "likes", "created_at", "relevance", "rank")


@query(
    "u4_united_feeds",
    f"""WITH {_REDDIT_SQL} SELECT id, author, likes, source FROM ({_stocktwits_sql('NULL', 'NULL')})
        UNION ALL SELECT id, author, likes, source FROM ({_TWITTER_SQL})
        UNION ALL SELECT id, author, likes, source FROM posts""",
)
def united_feeds(spark, sf):
    raws = {
        "stocktwits": adapters.landed(spark, "stocktwits", _land_stocktwits(spark, sf)),
        "twitter": adapters.landed(spark, "twitter", _land_twitter(spark, sf)),
        "reddit": adapters.landed(spark, "reddit", _land_reddit(spark, sf)),
    }
    return adapters.messages_from(raws).select("id", "author", "likes", "source")


@query("x1_chosen_sources", f"SELECT {', '.join(RECORD_COLUMNS)} FROM ({_TWITTER_SQL})")
def chosen_sources(spark, sf):
    """The registry with an explicit choice; feeds that were not asked for or not landed add nothing."""
    raws = {
        "twitter": adapters.landed(spark, "twitter", _land_twitter(spark, sf)),
        "reddit": adapters.landed(spark, "reddit", _land_reddit(spark, sf)),
    }
    return adapters.messages_from(raws, ["stocktwits", "twitter"]).select(*RECORD_COLUMNS)


# --- streams ------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return messages_of_events(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet"))


@query("s11_submission_stream", f"WITH {_REDDIT_SQL} SELECT {', '.join(CSV_COLUMNS)} FROM posts")
def submission_stream(spark, sf):
    out = scratch_path(spark, "submissions")
    stream = adapters.reddit_messages(adapters.landing(spark, "reddit", _land_reddit(spark, sf)))
    written = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/_at").option("path", f"{out}/rows")
    written.trigger(availableNow=True).start().awaitTermination()
    return sinks.read_messages(spark, f"{out}/rows").select(*CSV_COLUMNS)


@query(
    "r1_per_arrival_callback",
    f"WITH {_REDDIT_SQL} SELECT author, count(*) AS n, sum(likes)::BIGINT AS likes FROM posts GROUP BY 1",
)
def per_arrival_callback(spark, sf):
    """A user function sees every micro-batch; here it tallies authors."""
    out = scratch_path(spark, "callback")

    def tally(batch: DataFrame, batch_id: int) -> None:
        counted = batch.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.sum("likes").alias("likes"))
        counted.write.mode("overwrite").parquet(f"{out}/rounds/round={batch_id}")

    stream = adapters.reddit_messages(adapters.landing(spark, "reddit", _land_reddit(spark, sf)))
    feeds.for_each_batch(stream, tally, f"{out}/at", drain=True).awaitTermination()
    rounds = spark.read.parquet(f"{out}/rounds")
    return rounds.groupBy("author").agg(F.sum("n").alias("n"), F.sum("likes").alias("likes"))


@query("r2_streaming_ingest", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev")
def streaming_ingest(spark, sf):
    """The stream into a table that already holds a week of it."""
    out = scratch_path(spark, "ingest")
    sinks.insert_if_absent(event_messages(spark, sf).where("created_at < '2024-01-08'"), f"{out}/messages")
    feeds.ingest(_event_stream(spark, sf), f"{out}/messages", f"{out}/at", drain=True).awaitTermination()
    return sinks.read_messages(spark, f"{out}/messages")


@query(
    "a13_inserted_per_batch",
    f"""WITH {EV_SQL} SELECT 'first' AS load, count(*) AS seen, count(*) FILTER (likes % 7 = 0) AS rejected,
        count(*) FILTER (likes % 7 <> 0) AS inserted, 'ok' AS status FROM ev WHERE created_at < '2024-01-16'
        UNION ALL SELECT 'repeated', count(*), count(*) FILTER (likes % 7 = 0), 0, 'no_new_rows' FROM ev WHERE created_at < '2024-01-16'
        UNION ALL SELECT 'all', count(*), count(*) FILTER (likes % 7 = 0),
        count(*) FILTER (likes % 7 <> 0 AND created_at >= '2024-01-16'), 'ok' FROM ev""",
)
def inserted_per_batch(spark, sf):
    path = scratch_path(spark, "messages")
    messages = event_messages(spark, sf).withColumn("body", F.when(F.col("likes") % 7 != 0, F.col("body")))
    half = messages.where("created_at < '2024-01-16'")
    counts = []
    for name, rows in (("first", half), ("repeated", half), ("all", messages)):
        result = sinks.insert_if_absent(rows, path)
        counts.append((name, result["seen"], result["rejected"], result["inserted"], result["status"]))
    return spark.createDataFrame(counts, "load string, seen long, rejected long, inserted long, status string")


_ALL_MARKERS_SQL = f"""WITH {EV_SQL} SELECT ticker, min_by(id, (created_at, CAST(id AS BIGINT))) AS oldest_id,
    min(created_at) AS oldest_at, max_by(id, (created_at, -CAST(id AS BIGINT))) AS newest_id, max(created_at) AS newest_at,
    count(*) AS n FROM ev GROUP BY ticker"""


@query("r3_running_markers", _ALL_MARKERS_SQL)
def running_markers(spark, sf):
    out = scratch_path(spark, "markers")
    state = feeds.running_markers(_event_stream(spark, sf))
    feeds.keep_latest(state, f"{out}/versions", f"{out}/at", drain=True).awaitTermination()
    return feeds.latest_markers(spark.read.parquet(f"{out}/versions"))


@query("r3_markers_from_state", _ALL_MARKERS_SQL)
def markers_from_state(spark, sf):
    """The events landed as nine files, one a round; markers read from the stream's state."""
    out = scratch_path(spark, "state-markers")
    events = table(spark, sf, "events")
    events.repartition(9).write.parquet(f"{out}/landed")
    landed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/landed")
    query_ = feeds.track_markers(messages_of_events(landed), f"{out}/at", drain=True)
    query_.awaitTermination()
    if len([p for p in query_.recentProgress if p["numInputRows"]]) < min(9, events.count()):
        raise RuntimeError("fewer rounds than files")
    return feeds.markers_from_state(spark, f"{out}/at")


@query("r4_resumed_ingest", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev")
def resumed_ingest(spark, sf):
    """A stream that stops and resumes from its checkpoint after more files have landed."""
    out = scratch_path(spark, "resume")
    events = table(spark, sf, "events")
    for part in ("ts < '2024-01-12'", "ts >= '2024-01-12'"):
        events.where(part).write.mode("append").parquet(f"{out}/landed")
        stream = messages_of_events(spark.readStream.schema(events.schema).parquet(f"{out}/landed"))
        feeds.ingest(stream, f"{out}/messages", f"{out}/at", drain=True).awaitTermination()
    return sinks.read_messages(spark, f"{out}/messages")


@query(
    "r4_resumed_forward_fetch",
    f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev",
)
def resumed_forward_fetch(spark, sf):
    """Batch resume: markers are read back from the store and only newer rows are fetched and added."""
    path = scratch_path(spark, "messages")
    messages = event_messages(spark, sf)
    sinks.insert_if_absent(messages.where("sentiment = 1 OR created_at < '2024-01-12'"), path)
    stored = sinks.read_messages(spark, path)
    known = materialise(ticker_markers(stored.where("created_at < '2024-01-12'")), "markers")
    sinks.insert_if_absent(beyond_cursor(messages, known, FORWARD), path)
    return sinks.read_messages(spark, path)


@query(
    "r5_live_hourly_sentiment",
    f"""WITH {EV_SQL} SELECT ticker, date_trunc('hour', created_at) AS hour,
        strftime(date_trunc('hour', created_at), '%m/%d %H') AS label, round(avg(sentiment), 6) AS bullish_ratio, count(*) AS n
        FROM ev WHERE sentiment <> -69 AND date_trunc('hour', created_at) + INTERVAL 1 HOUR
             <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM ev) GROUP BY 1, 2, 3""",
)
def live_hourly_sentiment(spark, sf):
    """Windows closed by the watermark; the open ones at the stream's end are not out yet."""
    out = scratch_path(spark, "live")
    windows = feeds.live_sentiment(_event_stream(spark, sf))
    written = windows.writeStream.format("parquet").option("checkpointLocation", f"{out}/at").option("path", f"{out}/rows")
    written.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").withColumn("bullish_ratio", F.round("bullish_ratio", 6))


@query(
    "r5_window_accounting",
    f"""WITH {EV_SQL},
    lab AS (SELECT created_at, CASE WHEN created_at >= TIMESTAMP '2024-01-15' THEN 0
                                    WHEN created_at >= TIMESTAMP '2024-01-08' THEN 1 ELSE 2 END AS round
            FROM ev WHERE sentiment <> -69),
    mark AS (SELECT max(created_at) - INTERVAL 1 HOUR AS wm FROM lab WHERE round = 0),
    seen AS (SELECT created_at, round = 2 AND created_at <= wm AS late, wm FROM lab, mark)
    SELECT count(*) FILTER (WHERE NOT late AND date_trunc('hour', created_at) + INTERVAL 1 HOUR <= wm)::BIGINT AS emitted,
           count(*) FILTER (WHERE NOT late AND date_trunc('hour', created_at) + INTERVAL 1 HOUR > wm)::BIGINT AS open,
           count(*) FILTER (WHERE late)::BIGINT AS late, count(*)::BIGINT AS input
    FROM seen""",
)
def window_accounting(spark, sf):
    """The month lands newest part first, one part a round: emitted, open and late rows add up.

    Spark drops a row as late by the watermark of the round before (round 1 still closes the
    middle part's windows and emits them); the oldest part, in round 2, is late.
    """
    out = scratch_path(spark, "accounted")
    events = table(spark, sf, "events")
    parts = (("a", "ts >= '2024-01-15'"), ("b", "ts >= '2024-01-08' AND ts < '2024-01-15'"), ("c", "ts < '2024-01-08'"))
    for name, part in parts:
        events.where(part).coalesce(1).write.parquet(f"{out}/landed/{name}")
    landed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/landed/*")
    windows = feeds.live_sentiment(messages_of_events(landed))
    started = windows.writeStream.format("parquet").option("checkpointLocation", f"{out}/at").option("path", f"{out}/rows")
    running = started.trigger(availableNow=True).start()
    running.awaitTermination()
    counts = feeds.window_accounting(spark, running, f"{out}/rows", f"{out}/at")
    read = labelled(messages_of_events(events)).count()
    late = read - counts["emitted"] - counts["open"]
    if late < counts["late_groups"] or (late > 0) != (counts["late_groups"] > 0):
        raise RuntimeError(f"rows unaccounted for: {counts} of {read}")
    return spark.createDataFrame([(counts["emitted"], counts["open"], late, read)], "emitted BIGINT, open BIGINT, late BIGINT, input BIGINT")


@query(
    "r5_back_filled_hourly",
    f"""WITH {EV_SQL} SELECT ticker, date_trunc('hour', created_at) AS hour,
        strftime(date_trunc('hour', created_at), '%m/%d %H') AS label, round(avg(sentiment), 6) AS bullish_ratio, count(*) AS n
        FROM ev WHERE sentiment <> -69 GROUP BY 1, 2, 3""",
)
def back_filled_hourly(spark, sf):
    """The form without a watermark: every hour comes out, none is dropped as late."""
    out = scratch_path(spark, "backfill")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rounds/round={batch_id}")

    windows = feeds.back_filled_sentiment(_event_stream(spark, sf))
    started = windows.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{out}/at")
    started.trigger(availableNow=True).start().awaitTermination()
    latest = (
        spark.read.parquet(f"{out}/rounds")
        .groupBy("ticker", "hour", "label")
        .agg(F.max_by("bullish_ratio", "round").alias("bullish_ratio"), F.max_by("n", "round").alias("n"))
    )
    return latest.withColumn("bullish_ratio", F.round("bullish_ratio", 6))


@query(
    "x3_callback_histogram",
    f"WITH {EV_SQL} SELECT sentiment, count(*) AS n FROM ev WHERE sentiment IS NOT NULL GROUP BY 1",
)
def callback_histogram(spark, sf):
    """A callback built from a batch operator."""
    out = scratch_path(spark, "histogram")

    def tally(batch: DataFrame, batch_id: int) -> None:
        aggregates.class_histogram(batch).write.mode("overwrite").parquet(f"{out}/rounds/round={batch_id}")

    feeds.for_each_batch(_event_stream(spark, sf), tally, f"{out}/at", drain=True).awaitTermination()
    return spark.read.parquet(f"{out}/rounds").groupBy("sentiment").agg(F.sum("n").alias("n"))
