"""File sources with explicit schemas: CSV, Parquet, JSON corpora, listings, ticker lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpulse.functions.hashing import surrogate_id
from msgpulse.functions.labels import mean_score, sentiment_of_mean
from msgpulse.schema import CSV_COLUMNS, FIQA, conform

_CSV_TYPES = {"sentiment": T.DoubleType(), "likes": T.LongType(), "replies": T.LongType()}

JSON_CORPUS_SCHEMA = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("sentence", T.StringType()),
            T.StructField("info", T.ArrayType(T.StructType([T.StructField("sentiment_score", T.StringType())]))),
        ]
    ),
)


def csv_corpus(spark: SparkSession, root: str, columns: Sequence[str] = tuple(CSV_COLUMNS)) -> DataFrame:
    """Every ``*.csv`` below a root as messages.

    ``columns`` is the header order of these files; read corpora with another
    header separately and unite them by name. Labels may be written as whole or
    decimal numbers, and headers repeated by appending writers are skipped. Values that are not of
    their type become NULL; ``csv_corpus_and_rejects`` sets such rows apart. Quoted line breaks are
    honoured, so the file is the unit of parallelism; export corpora as many files.
    """
    return conform(_csv_values(_csv_text(spark, root, columns), columns))


def csv_corpus_and_rejects(
    spark: SparkSession, root: str, columns: Sequence[str] = tuple(CSV_COLUMNS)
) -> tuple[DataFrame, DataFrame]:
    """Messages whose values all have their type, and the rows, as text, in which some value has not."""
    text = _csv_text(spark, root, columns)
    wrong = F.lit(False)
    for name, kind in _CSV_TYPES.items():
        if name in columns:
            wrong = wrong | (F.col(name).isNotNull() & F.col(name).try_cast(kind).isNull())
    if "created_at" in columns:
        wrong = wrong | (F.col("created_at").isNotNull() & F.try_to_timestamp("created_at").isNull())
    return conform(_csv_values(text.where(~wrong), columns)), text.where(wrong)


def _csv_text(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """All values as text, without repeated headers."""
    raw = (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("multiLine", True)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(root)
    )
    repeated_header = (F.col("id") == "id") & (F.col("body") == "body")
    return raw.where(~F.coalesce(repeated_header, F.lit(False)))


def _csv_values(text: DataFrame, columns: Sequence[str]) -> DataFrame:
    return text.withColumns({c: F.col(c).try_cast(kind) for c, kind in _CSV_TYPES.items() if c in columns})


def parquet_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Stored message tables; filters and columns are pushed into the scan."""
    return spark.read.parquet(*paths)


def one_ticker(messages: DataFrame, ticker: str) -> DataFrame:
    """One ticker's store; prunes to its partition on a table laid out by ticker."""
    return messages.where(F.col("ticker") == ticker)


def json_corpus(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Labelled sentences from ``{key: {sentence, info: [{sentiment_score}]}}`` objects.

    Every line is an object, so large files are split; ``whole_file`` reads one object per
    file instead, which makes the file the unit of parallelism.
    """
    text = spark.read.text(path, wholetext=whole_file)
    return text.select(F.explode(F.from_json("value", JSON_CORPUS_SCHEMA)).alias("key", "entry")).select(
        "key", F.col("entry.sentence").alias("sentence"), F.col("entry.info.sentiment_score").alias("scores")
    )


def json_corpus_messages(corpus: DataFrame, load_date, source: str = FIQA) -> DataFrame:
    """Score lists to three-way labels, with ids derived from the content."""
    return conform(
        corpus.select(
            surrogate_id(F.lit("id"), F.col("key"), F.col("sentence")).alias("id"),
            F.col("sentence").alias("body"),
            surrogate_id(F.lit("author"), F.col("key"), F.col("sentence")).alias("author"),
            F.lit(load_date).cast("date").cast("timestamp").alias("created_at"),
            sentiment_of_mean(mean_score(F.col("scores"))).alias("sentiment"),
            F.lit(source).alias("source"),
        )
    )


def listing(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One pipe-delimited symbol listing with a header; all columns are text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "|").option("header", True).option("enforceSchema", False).csv(path)


def listing_symbol(columns: Sequence[str]) -> Column:
    """The symbol column of a listing, which goes by one of two names."""
    named = [F.col(f"`{c}`") for c in ("Symbol", "ACT Symbol") if c in columns]
    return F.coalesce(*named)


def symbols(*listings: DataFrame) -> DataFrame:
    """All listings under one another, reduced to their symbol."""
    united = listings[0]
    for more in listings[1:]:
        united = united.unionByName(more, allowMissingColumns=True)
    return united.select(listing_symbol(united.columns).alias("ticker"))


def ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line."""
    return spark.read.text(path).select(F.col("value").alias("ticker"))


def ticker_from_path(path: Column | None = None) -> Column:
    """The ticker encoded in a store's folder name (``…/tickers/<T>/…``)."""
    path = F.col("_metadata.file_path") if path is None else path
    return F.regexp_extract(F.url_decode(path), r"tickers/([^/]+)/", 1)
