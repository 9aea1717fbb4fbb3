"""Readers and sinks on small files."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from msgpulse.operators import aggregates, combine, migrate
from msgpulse.schema import MESSAGE_COLUMNS, conform
from msgpulse.sources import adapters, files, lexicon, sinks, sqlite_stores


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_csv_corpora_with_different_headers(spark, tmp_path):
    header = "id,body,author,created_at,source,sentiment,likes,replies\n"
    write(
        tmp_path / "a/b/posts.csv",
        header
        + '1,"two\nlines, one comma",u,2020-12-29 10:00:00,FIQA,-1,3,1\n'
        + header
        + '2,"say ""hi""",u,2020-12-29 10:00:00.250000,FIQA,1.0,,\n3,day only,u,2020-12-29,FIQA,,0,0\n',
    )
    write(tmp_path / "a/notes.txt", "not a corpus")
    write(tmp_path / "c/more.csv", "id,body,author,created_at,source,sentiment\n9,x,u,2020-12-30 00:00:00,FIQA,0\n")
    full = files.csv_corpus(spark, str(tmp_path / "a"))
    short = files.csv_corpus(spark, str(tmp_path / "c"), ["id", "body", "author", "created_at", "source", "sentiment"])
    rows = {r.id: r for r in combine.consolidated(full, short).collect()}
    assert set(rows) == {"1", "2", "3", "9"}
    assert rows["1"].body == "two\nlines, one comma" and rows["1"].sentiment == -1
    assert rows["2"].body == 'say "hi"' and rows["2"].sentiment == 1 and rows["2"].likes == 0
    assert rows["2"].created_at.microsecond == 250000 and rows["3"].created_at.hour == 0
    assert rows["9"].likes == 0
    assert {r.sentiment for r in combine.cleaned(combine.consolidated(full)).collect()} == {0, 1, None}


def test_csv_with_another_header_is_refused(spark, tmp_path):
    write(tmp_path / "x.csv", "id,text\n1,a\n")
    with pytest.raises(Exception, match="header"):
        files.csv_corpus(spark, str(tmp_path), ["id", "body"]).collect()


def test_csv_append_round_trip(spark, golden, tmp_path):
    path = str(tmp_path / "out")
    sinks.append_csv(golden.where("id = '1'"), path)
    sinks.append_csv(golden.where("id = '3'").withColumn("body", F.lit('a "b", c\nd')), path)
    rows = files.csv_corpus(spark, path).orderBy("author").collect()
    assert [(r.id, r.body) for r in rows] == [("1", "up we go"), ("3", 'a "b", c\nd'), ("1", "later copy")]


def store(path, rows, order="id text PRIMARY KEY, body text NOT NULL, author text NOT NULL, created_at timestamp NOT NULL, sentiment, source NOT NULL, likes DEFAULT 0, replies DEFAULT 0"):
    path.parent.mkdir(parents=True)
    conn = sqlite3.connect(path)
    conn.execute(f"CREATE TABLE messages ({order})")
    conn.executemany(
        "INSERT INTO messages (id, body, author, created_at, sentiment, source) VALUES (?, ?, ?, ?, ?, 'StockTwits')", rows
    )
    conn.commit()
    conn.close()


@pytest.fixture
def stores(tmp_path):
    """An old store (uncertain code) with another column order, and a new one (NULL)."""
    store(
        tmp_path / "tickers/AAPL/twits.db",
        [("1", "a", "u", "2020-12-29 10:00:00", -69), ("2", "b", "u", "2020-12-30 10:00:00.5", 1)],
        "body text, id text PRIMARY KEY, author text, created_at timestamp, replies DEFAULT 0, likes DEFAULT 7, source, sentiment",
    )
    store(
        tmp_path / "tickers/BRK.B/twits.db",
        [(str(i), "c", "u", f"2021-01-{i:02d} 00:00:00", None if i % 2 else 0) for i in range(1, 11)],
    )
    return str(tmp_path)


def test_sqlite_stores(spark, stores):
    rows = conform(sqlite_stores.store_corpus(spark, stores))
    assert rows.columns == MESSAGE_COLUMNS
    found = {(r.ticker, r.id): r for r in rows.collect()}
    assert len(found) == 12
    assert found["AAPL", "1"].sentiment == -69 and found["AAPL", "1"].likes == 7
    assert found["AAPL", "2"].created_at.microsecond == 500000
    assert found["BRK.B", "1"].sentiment is None and found["BRK.B", "2"].sentiment == 0


def test_large_stores_are_split_without_loss(spark, stores):
    split = sqlite_stores.store_corpus(spark, stores, split_bytes=1, split_rows=3)
    assert split.rdd.getNumPartitions() > 4
    assert sorted((r.ticker, r.id) for r in split.collect()) == sorted(
        (r.ticker, r.id) for r in sqlite_stores.store_corpus(spark, stores).collect()
    )


def test_store_filters_reach_the_reader(spark, stores):
    rows = sqlite_stores.store_corpus(spark, stores)
    assert rows.where("ticker = 'AAPL'").count() == 2
    assert rows.where("sentiment IS NULL").count() == 5
    assert rows.where("sentiment = 0 AND ticker = 'BRK.B'").count() == 5
    assert rows.where("created_at >= '2021-01-04' AND created_at < '2021-01-06'").count() == 2
    assert rows.where("ticker = 'AAPL' AND ticker = 'MSFT'").count() == 0
    reader = sqlite_stores.MessageStoreReader({"path": stores})
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    kept = list(reader.pushFilters([EqualTo(("ticker",), "AAPL"), IsNull(("sentiment",)), GreaterThan(("created_at",), "2020-12-29 11")]))
    assert len(kept) == 3 and [p for part in reader.partitions() for p in part.ranges][0][0].endswith("AAPL/twits.db")
    assert [c for c, _ in reader.conditions] == ["sentiment IS NULL", "substr(created_at, 1, 10) >= ?"]


def test_empty_root_has_no_rows(spark, tmp_path):
    assert sqlite_stores.store_corpus(spark, str(tmp_path)).count() == 0


def test_store_migration(spark, stores):
    old = sqlite_stores.store_corpus(spark, stores).where("ticker = 'AAPL'")
    new = migrate.migrated(old)
    assert aggregates.migration_parity(old, new).first().same
    assert new.where("sentiment = -69").count() == 0 and old.where("sentiment = -69").count() == 1


def test_unreadable_payloads_come_back(spark, tmp_path):
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.json").write_text('{"ticker":"A","messages":[{"id":1}]}\n{"ticker":"A","messages":[{"id":2\n\n')
    good, bad = adapters.landed_and_rejects(spark, "stocktwits", str(tmp_path / "cut"))
    assert good.count() == 1 and [r.record for r in bad.collect()] == ['{"ticker":"A","messages":[{"id":2']
    (tmp_path / "pretty").mkdir()
    (tmp_path / "pretty" / "b.json").write_text('{\n "ticker": "A",\n "messages": [{"id": 3}]\n}\n')
    good, bad = adapters.landed_and_rejects(spark, "stocktwits", str(tmp_path / "pretty"), multi_line=True)
    assert [r.messages[0].id for r in good.collect()] == [3] and bad.count() == 0


def test_values_of_another_type_come_back(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,body,author,created_at,source,sentiment,likes,replies\n1,a,u,2020-01-01 00:00:00,s,bull,1,0\n2,b,u,2020-01-01 00:00:00,s,1,x,0\n3,c,u,n/a,s,0,1,0\n4,d,u,2020-01-01 00:00:00,s,1.0,,\n")
    good, bad = files.csv_corpus_and_rejects(spark, str(tmp_path))
    assert [(r.id, r.sentiment, r.likes) for r in good.collect()] == [("4", 1, 0)]
    assert sorted(r.id for r in bad.collect()) == ["1", "2", "3"]
    assert files.csv_corpus(spark, str(tmp_path)).count() == 4


def test_json_corpus(spark, tmp_path):
    corpus = {
        "1": {"sentence": "up", "info": [{"sentiment_score": "0.05", "snippets": "x"}]},
        "2": {"sentence": "flat", "info": [{"sentiment_score": "0.04"}]},
        "3": {"sentence": "down", "info": [{"sentiment_score": "-0.3"}, {"sentiment_score": "0.1"}]},
        "4": {"sentence": "none", "info": []},
    }
    write(tmp_path / "posts.json", json.dumps(corpus, indent=2))
    rows = files.json_corpus_messages(files.json_corpus(spark, str(tmp_path / "posts.json"), whole_file=True), "2021-03-01").collect()
    assert {r.body: r.sentiment for r in rows} == {"up": 1, "flat": -69, "down": 0, "none": None}
    assert {r.source for r in rows} == {"FIQA"} and len({r.id for r in rows} | {r.author for r in rows}) == 8
    again = files.json_corpus_messages(files.json_corpus(spark, str(tmp_path / "posts.json"), whole_file=True), "2021-03-01").collect()
    assert sorted(rows) == sorted(again)


def test_listings_with_either_symbol_header(spark, tmp_path):
    write(tmp_path / "a.txt", "Symbol|Security Name|Test Issue\nAAPL|Apple|N\nBRK.B|Berkshire|N\n")
    write(tmp_path / "b.txt", "ACT Symbol|Security Name\nBRK.B|Berkshire\nT|Telephone\n")
    first = files.listing(spark, str(tmp_path / "a.txt"), ["Symbol", "Security Name", "Test Issue"])
    second = files.listing(spark, str(tmp_path / "b.txt"), ["ACT Symbol", "Security Name"])
    found = aggregates.distinct_symbols(files.symbols(first, second)).collect()
    assert sorted(r.ticker for r in found) == ["AAPL", "BRK.B", "T"]


def test_ticker_list_and_path(spark, tmp_path):
    write(tmp_path / "tickers.txt", "AAPL\nBRK.B\nXRP.X\n")
    assert [r.ticker for r in files.ticker_list(spark, str(tmp_path / "tickers.txt")).collect()] == ["AAPL", "BRK.B", "XRP.X"]
    write(tmp_path / "tickers/BRK.B/rows.csv", "1\n")
    raw = spark.read.schema("id string").option("recursiveFileLookup", True).csv(str(tmp_path / "tickers"))
    assert raw.select(files.ticker_from_path().alias("t")).first().t == "BRK.B"


def test_partitioned_table_round_trip(spark, golden, tmp_path):
    path = str(tmp_path / "messages")
    sinks.write_parquet(golden.withColumn("ticker", F.when(F.col("id") != "3", F.col("ticker"))), path)
    back = sinks.read_messages(spark, path)
    assert back.columns == MESSAGE_COLUMNS and back.count() == 6
    assert back.where("ticker IS NULL").first().id == "3"
    assert files.one_ticker(back, "MSFT").first().id == "4"


def test_insert_if_absent_twice_is_once(spark, golden, tmp_path):
    path = str(tmp_path / "messages")
    first = sinks.insert_if_absent(golden, path)
    assert first == {"seen": 6, "rejected": 1, "inserted": 4, "status": "ok"}
    again = sinks.insert_if_absent(golden, path)
    assert again == {"seen": 6, "rejected": 1, "inserted": 0, "status": "no_new_rows"}
    kept = {r.id: r.body for r in sinks.read_messages(spark, path).collect()}
    assert kept == {"1": "up we go", "2": "going down", "3": "no idea", "4": "who knows"}


def test_same_id_in_two_stores_is_two_messages(spark, golden, tmp_path):
    path = str(tmp_path / "messages")
    sinks.insert_if_absent(golden.where("id = '2'"), path)
    other = golden.where("id = '2'").withColumn("ticker", F.lit("MSFT"))
    assert sinks.insert_if_absent(other, path)["inserted"] == 1
    assert sinks.insert_if_absent(other, path, keys=("id",))["inserted"] == 0


def test_spam_lists(spark):
    assert len(lexicon.SPAM_PHRASES) == len(set(lexicon.SPAM_PHRASES)) == 38
    assert lexicon.forced_spam(spark).count() == 20 and lexicon.forced_ham(spark).count() == 33
    assert lexicon.spam_phrases(spark).count() == 38


def payload(spark, tmp_path, name, *objects):
    write(tmp_path / name / "x.json", "\n".join(json.dumps(o) for o in objects))
    return str(tmp_path / name)


def test_stocktwits_labels_in_both_modes(spark, tmp_path):
    cases = [
        ({"sentiment": {"basic": "Bullish"}}, 1, 1),
        ({"sentiment": {"basic": "Bearish"}}, 0, 0),
        ({"sentiment": None}, None, None),
        ({}, None, 0),
        ({"sentiment": {"basic": "Other"}}, None, 0),
        ("absent", None, 0),
    ]
    twits = []
    for i, (entities, _, _) in enumerate(cases):
        twit = {"id": i, "body": "b", "created_at": "2020-12-29T10:00:00Z"}
        if entities != "absent":
            twit["entities"] = entities
        twits.append(twit)
    twits[0] |= {"user": {"id": 77}, "likes": {"total": 4}, "conversation": {"replies": 2}}
    path = payload(spark, tmp_path, "st", {"ticker": "A", "messages": twits})
    plain = adapters.stocktwits_messages(adapters.landed(spark, "stocktwits", path)).orderBy("id").collect()
    strict = adapters.stocktwits_messages(adapters.landed(spark, "stocktwits_strict", path), True).orderBy("id").collect()
    assert [r.sentiment for r in plain] == [c[1] for c in cases]
    assert [r.sentiment for r in strict] == [c[2] for c in cases]
    assert (plain[0].author, plain[0].likes, plain[0].replies) == ("77", 4, 2)
    assert (plain[1].author, plain[1].likes, plain[1].replies) == ("", 0, 0)
    assert str(plain[0].created_at) == "2020-12-29 10:00:00" and plain[0].ticker == "A"


def test_twitter_filter_and_defaults(spark, tmp_path):
    tweets = [
        {"id": "1", "text": "$A up", "lang": "en", "author_id": "u", "created_at": "2020-12-29T10:00:00+02:00", "public_metrics": {"like_count": 3}},
        {"id": "2", "text": "A up", "lang": "en", "created_at": "2020-12-29T10:00:00Z"},
        {"id": "3", "text": "$A hoch", "lang": "de", "created_at": "2020-12-29T10:00:00Z"},
        {"id": "4", "text": "$A", "lang": "en", "created_at": "2020-12-29T10:00:00.000Z"},
    ]
    raw = adapters.landed(spark, "twitter", payload(spark, tmp_path, "tw", {"data": tweets}))
    rows = {r.id: r for r in adapters.twitter_messages(raw).collect()}
    assert set(rows) == {"1", "4"}
    assert (rows["1"].likes, rows["1"].created_at.hour, rows["1"].sentiment) == (3, 8, None)
    assert (rows["4"].likes, rows["4"].author, rows["4"].replies) == (0, "", 0)


def post(i, **changes):
    base = dict(kind="submission", id=f"p{i:03d}", title="GME ", selftext="to go", author={"name": "n"}, created_utc=1609459200.0, score=i, num_comments=2, subreddit="stocks", relevance=i / 1000)
    return base | changes


def test_reddit_search(spark, tmp_path):
    posts = [post(i) for i in range(101)]
    posts += [post(200, kind="comment"), post(201, created_utc=1609459200.0 - 86400 * 2), post(202, subreddit="gardening")]
    posts += [post(203, title=None, selftext="about amc.", relevance=9.0), post(204, title="GMEX", selftext=None)]
    raw = adapters.landed(spark, "reddit", payload(spark, tmp_path, "re", *posts))
    listed = spark.createDataFrame([("GME",), ("AMC",)], "ticker string")
    found = adapters.reddit_search(raw, listed, "2021-01-01 12:00:00").collect()
    gme = [r for r in found if r.ticker == "GME"]
    assert len(gme) == 100 and "p000" not in {r.id for r in gme}
    assert [(r.id, r.body) for r in found if r.ticker == "AMC"] == [("p203", "about amc.")]
    everything = {r.id: r for r in adapters.reddit_messages(raw).collect()}
    assert "p200" not in everything and "p202" not in everything and "p201" in everything
    assert (everything["p005"].body, everything["p005"].likes, everything["p005"].replies) == ("GME to go", 5, 2)


def test_missing_feeds_are_skipped(spark, tmp_path):
    raw = adapters.landed(spark, "reddit", payload(spark, tmp_path, "re", post(1)))
    assert adapters.messages_from({"reddit": raw}).count() == 1
    with pytest.raises(ValueError):
        adapters.messages_from({"reddit": raw}, ["twitter"])
