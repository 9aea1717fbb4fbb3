"""The given tables seen as message data, in Spark and in SQL.

``*_SQL`` are common table expressions with the same rows as the function next to
them; the comparison queries are built on those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.schema import MESSAGE_COLUMNS

FIRST_MINUTE = 1704067200  # 2024-01-01 00:00:00 UTC


# Explicit schemas, so that opening a table reads no file.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def letter(number: Column) -> Column:
    return F.chr((F.lit(65) + number % 20).cast("int"))


def messages_of_events(events: DataFrame) -> DataFrame:
    """Events (batch or stream) as messages: user groups are tickers, event types labels."""
    return events.selectExpr(
        "CAST(event_id AS STRING) AS id",
        "concat('$', chr(CAST(65 + user_id % 20 AS INT)), ' ', event_type) AS body",
        "CAST(user_id AS STRING) AS author",
        "CAST(ts AS TIMESTAMP) AS created_at",
        """CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN 0
                WHEN event_type = 'click' THEN -69 END AS sentiment""",
        "CASE user_id % 3 WHEN 0 THEN 'StockTwits' WHEN 1 THEN 'Twitter' ELSE 'Reddit' END AS source",
        "coalesce(CAST(get_json_object(props, '$.k') AS BIGINT), 0) AS likes",
        "user_id % 4 AS replies",
        "chr(CAST(65 + user_id % 20 AS INT)) AS ticker",
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of_events(table(spark, sf_dir, "events"))


EV_SQL = """ev AS (
    SELECT CAST(event_id AS VARCHAR) AS id,
           '$' || chr(CAST(65 + user_id % 20 AS INTEGER)) || ' ' || event_type AS body,
           CAST(user_id AS VARCHAR) AS author,
           ts AS created_at,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN 0
                WHEN event_type = 'click' THEN -69 END AS sentiment,
           CASE user_id % 3 WHEN 0 THEN 'StockTwits' WHEN 1 THEN 'Twitter' ELSE 'Reddit' END AS source,
           coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS likes,
           user_id % 4 AS replies,
           chr(CAST(65 + user_id % 20 AS INTEGER)) AS ticker
    FROM events)"""
EV_COLUMNS_SQL = ", ".join(MESSAGE_COLUMNS)


def event_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean of the event value as a stand-in for a closing price."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(letter(F.col("user_id")).alias("ticker"), F.to_date("ts").alias("day"))
        .agg(F.avg("value").alias("close"))
    )


PRICES_SQL = """prices AS (
    SELECT chr(CAST(65 + user_id % 20 AS INTEGER)) AS ticker, CAST(ts AS DATE) AS day, avg(value) AS close
    FROM events GROUP BY 1, 2)"""


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the log of fetches: event types are status codes."""
    status = (
        F.when(F.col("event_type") == "click", 429)
        .when(F.col("event_type") == "signup", 403)
        .when(F.col("event_type") == "error", 500)
        .otherwise(200)
    )
    return table(spark, sf_dir, "events").select(
        letter(F.col("user_id")).alias("ticker"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        status.alias("status"),
        (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("n_rows"),
    )


LOG_SQL = """fetches AS (
    SELECT chr(CAST(65 + user_id % 20 AS INTEGER)) AS ticker, ts AS fetched_at,
           CASE event_type WHEN 'click' THEN 429 WHEN 'signup' THEN 403 WHEN 'error' THEN 500 ELSE 200 END AS status,
           CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS n_rows
    FROM events)"""


def document_messages(spark: SparkSession, sf_dir: str, strategy: str | None = None) -> DataFrame:
    """Documents as messages: quality is the label, toxic the spam flag, lang the ticker.

    ``strategy`` hints how the labels are joined; without it Spark decides by their size.
    """
    labels = table(spark, sf_dir, "labels")
    labels = labels.hint(strategy) if strategy else labels
    documents = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return documents.selectExpr(
        "CAST(doc_id AS STRING) AS id",
        "text AS body",
        "source AS author",
        f"timestamp_seconds(doc_id * 60 + {FIRST_MINUTE}) AS created_at",
        "quality AS sentiment",
        "CASE WHEN source = 'src0' THEN 'FIQA' ELSE 'StockTwits' END AS source",
        "n_chars AS likes",
        "CAST(0 AS BIGINT) AS replies",
        "upper(lang) AS ticker",
        "toxic AS is_spam",
    )


DOC_SQL = """doc AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS body, d.source AS author,
           make_timestamp(1704067200000000 + d.doc_id * 60000000) AS created_at,
           l.quality AS sentiment,
           CASE WHEN d.source = 'src0' THEN 'FIQA' ELSE 'StockTwits' END AS source,
           d.n_chars AS likes, CAST(0 AS BIGINT) AS replies, upper(d.lang) AS ticker, l.toxic AS is_spam
    FROM documents d LEFT JOIN labels l USING (doc_id))"""


def logit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two entries of each vector as a pair of logits, with a 0/1 class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding")[0].cast("double").alias("l0"),
        F.col("embedding")[1].cast("double").alias("l1"),
        (F.col("label") % 2).alias("label"),
    )


LOGITS_SQL = """pairs AS (
    SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1,
           label % 2 AS label
    FROM embeddings),
    scored AS (
    SELECT id, label, exp(l0) / (exp(l0) + exp(l1)) AS p0, exp(l1) / (exp(l0) + exp(l1)) AS p1 FROM pairs)"""
