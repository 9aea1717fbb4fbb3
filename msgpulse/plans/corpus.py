"""Sources, sinks, cleaning, set operations and look-ups on whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgpulse.functions.hashing import surrogate_id
from msgpulse.functions.labels import mean_score, remap_legacy, sentiment_of_mean, sentiment_of_pair, softmax_pair
from msgpulse.functions.text import UNICODE_SPACE, contains_any, strip_urls, tokens
from msgpulse.operators import aggregates, combine, dedup, filters, keyed, phrases, ranking
from msgpulse.plans.catalogue import query
from msgpulse.plans.inputs import (
    DOC_SQL,
    EV_COLUMNS_SQL,
    EV_SQL,
    LOGITS_SQL,
    document_messages,
    event_messages,
    logit_pairs,
    table,
)
from msgpulse.schema import CSV_COLUMNS, MESSAGE_COLUMNS, STORE_COLUMNS, conform
from msgpulse.session import materialise, scratch_path
from msgpulse.sources import compaction, files, sinks

# Phrases that occur in the given documents; the shipped lexicon is about another feed.
PHRASES = ["free", "$$$", "stupid", "(license", "a.b"]
_PHRASE_SQL = "(" + " OR ".join(f"contains(body, '{p}')" for p in PHRASES) + ")"

# --- sources ------------------------------------------------------------------------


@query("s1_csv_corpus", f"WITH {EV_SQL} SELECT {', '.join(CSV_COLUMNS)} FROM ev")
def csv_corpus(spark, sf):
    root = scratch_path(spark, "csv")
    sinks.append_csv(event_messages(spark, sf), f"{root}/nested/feed")
    return files.csv_corpus(spark, root).select(*CSV_COLUMNS)


@query(
    "s1_rejected_values",
    f"""WITH {EV_SQL} SELECT id, CASE WHEN likes % 3 = 0 THEN 'bull' ELSE CAST(sentiment AS VARCHAR) END AS sentiment,
        CASE WHEN likes % 5 = 0 THEN 'x' ELSE CAST(likes AS VARCHAR) END AS likes FROM ev WHERE likes % 3 = 0 OR likes % 5 = 0""",
)
def rejected_values(spark, sf):
    """Rows of a corpus in which a label or a number is none."""
    root = scratch_path(spark, "csv")
    text = event_messages(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in CSV_COLUMNS])
    third, fifth = F.col("likes").cast("bigint") % 3 == 0, F.col("likes").cast("bigint") % 5 == 0
    doctored = text.withColumns(
        {
            "sentiment": F.when(third, "bull").otherwise(F.col("sentiment")),
            "likes": F.when(fifth, "x").otherwise(F.col("likes")),
        }
    )
    doctored.write.option("header", True).csv(root)
    _, rejects = files.csv_corpus_and_rejects(spark, root)
    return rejects.select("id", "sentiment", "likes")


@query("s3_one_ticker", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev WHERE ticker = 'C'")
def one_ticker(spark, sf):
    path = scratch_path(spark, "messages")
    sinks.write_parquet(event_messages(spark, sf), path)
    return files.one_ticker(sinks.read_messages(spark, path), "C")


@query("s4_parquet_corpus", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def parquet_corpus(spark, sf):
    found = files.parquet_corpus(spark, f"{sf}/documents.parquet")
    return found.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


_CORPUS_SQL = """SELECT sha256('id' || chr(31) || CAST(vec_id AS VARCHAR) || chr(31) || 'vector ' || vec_id) AS id,
    'vector ' || vec_id AS body,
    sha256('author' || chr(31) || CAST(vec_id AS VARCHAR) || chr(31) || 'vector ' || vec_id) AS author,
    TIMESTAMP '2024-02-01' AS created_at,
    CASE WHEN abs(m) < 0.05 THEN -69 WHEN m >= 0.05 THEN 1 WHEN m IS NOT NULL THEN 0 END AS sentiment,
    'FIQA' AS source, CAST(0 AS BIGINT) AS likes, CAST(0 AS BIGINT) AS replies, CAST(NULL AS VARCHAR) AS ticker
    FROM (SELECT vec_id, list_sum(list_transform(embedding[1:label], lambda x: CAST(CAST(x AS VARCHAR) AS DOUBLE))) / label AS m
          FROM embeddings)"""


@query("s5_json_corpus", _CORPUS_SQL)
def json_corpus(spark, sf):
    """Score lists of 0 to 9 entries per sentence, one object per line."""
    path = scratch_path(spark, "corpus")
    scores = F.transform(
        F.slice("embedding", 1, F.col("label")), lambda x: F.struct(x.cast("string").alias("sentiment_score"))
    )
    sentence = F.concat(F.lit("vector "), F.col("vec_id").cast("string"))
    entry = F.struct(sentence.alias("sentence"), scores.alias("info"))
    vectors = table(spark, sf, "embeddings")
    vectors.select(F.to_json(F.create_map(F.col("vec_id").cast("string"), entry))).write.text(path)
    return files.json_corpus_messages(files.json_corpus(spark, path, whole_file=False), "2024-02-01")


@query(
    "s6_symbol_listings",
    """SELECT DISTINCT ticker FROM (SELECT p_brand || p_size AS ticker FROM part
       UNION ALL SELECT 'Brand#' || (s_suppkey % 60) FROM supplier)""",
)
def symbol_listings(spark, sf):
    first, second = scratch_path(spark, "listed"), scratch_path(spark, "listed")
    parts = table(spark, sf, "part").select(
        F.concat("p_brand", F.col("p_size").cast("string")).alias("Symbol"), F.col("p_name").alias("Security Name")
    )
    makers = table(spark, sf, "supplier").select(
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("ACT Symbol"),
        F.col("s_name").alias("Security Name"),
    )
    parts.write.option("sep", "|").option("header", True).csv(first)
    makers.write.option("sep", "|").option("header", True).csv(second)
    listings = [files.listing(spark, first, parts.columns), files.listing(spark, second, makers.columns)]
    return aggregates.distinct_symbols(files.symbols(*listings))


@query("s7_ticker_list", "SELECT DISTINCT p_name AS ticker FROM part")
def ticker_list(spark, sf):
    path = scratch_path(spark, "tickers")
    table(spark, sf, "part").select("p_name").distinct().write.text(path)
    return files.ticker_list(spark, path)


# --- sinks --------------------------------------------------------------------------


@query("k1_parquet_by_ticker", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev")
def parquet_by_ticker(spark, sf):
    path = scratch_path(spark, "messages")
    sinks.write_parquet(event_messages(spark, sf), path)
    return sinks.read_messages(spark, path)


@query("k2_csv_append", f"WITH {DOC_SQL} SELECT {', '.join(CSV_COLUMNS)} FROM doc WHERE sentiment IS NOT NULL")
def csv_append(spark, sf):
    path = scratch_path(spark, "csv")
    documents = document_messages(spark, sf)
    sinks.append_csv(filters.bulls(documents), path)
    sinks.append_csv(filters.bears(documents), path)
    return files.csv_corpus(spark, path).select(*CSV_COLUMNS)


@query("k3_insert_if_absent", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev")
def insert_if_absent(spark, sf):
    """The first half, then everything: the overlap must not be stored twice."""
    path = scratch_path(spark, "messages")
    messages = event_messages(spark, sf)
    sinks.insert_if_absent(messages.where("created_at < '2024-01-16'"), path)
    sinks.insert_if_absent(messages, path)
    return sinks.read_messages(spark, path)


@query("k3_compacted", f"WITH {EV_SQL} SELECT {EV_COLUMNS_SQL} FROM ev")
def compacted(spark, sf):
    """An insert per week, everything once more, then compaction: same rows, one file per ticker."""
    path = scratch_path(spark, "messages")
    messages = event_messages(spark, sf)
    day = F.dayofyear("created_at")
    for first in range(1, 367, 7):
        sinks.insert_if_absent(messages.where(day.between(first, first + 6)), path)
    sinks.insert_if_absent(messages, path)
    compaction.compact(spark, path)
    return sinks.read_messages(spark, path)


@query(
    "k4_keyed_update",
    f"""WITH {EV_SQL} SELECT id, coalesce(sentiment, CASE WHEN likes > 50 THEN 1 ELSE 0 END) AS sentiment FROM ev""",
)
def keyed_update(spark, sf):
    """Two rounds of predictions; the later version of an id applies."""
    path = scratch_path(spark, "predictions")
    messages = event_messages(spark, sf)
    missing = filters.unlabelled(messages)
    sinks.append_predictions(missing.select("id", F.lit(-69).alias("sentiment"), F.lit("v1").alias("model_version")), path)
    later = F.when(F.col("likes") > 50, 1).otherwise(0)
    sinks.append_predictions(missing.select("id", later.alias("sentiment"), F.lit("v2").alias("model_version")), path)
    return keyed.with_predictions(messages, sinks.read_predictions(spark, path)).select("id", "sentiment")


@query("k5_compressed_export", f"WITH {DOC_SQL} SELECT id, md5(body) AS body_md5, ticker FROM doc")
def compressed_export(spark, sf):
    path = scratch_path(spark, "export")
    sinks.write_parquet(document_messages(spark, sf).select(*MESSAGE_COLUMNS), path, compression="zstd")
    return sinks.read_messages(spark, path).select("id", F.md5("body").alias("body_md5"), "ticker")


# --- cleaning and projections -------------------------------------------------------

_STRIPPED = f"regexp_replace(html, 'http[^{UNICODE_SPACE}]+', '', 'g')"


@query("p10_strip_urls", f"SELECT page_id, length({_STRIPPED}) AS kept, md5({_STRIPPED}) AS text_md5 FROM pages")
def stripped_urls(spark, sf):
    text = strip_urls(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", F.length(text).cast("long").alias("kept"), F.md5(text).alias("text_md5")
    )


@query(
    "x2_built_in_for_callback",
    f"""WITH {DOC_SQL} SELECT id, md5(regexp_replace(body || ' https://x.example/' || id || ' end', 'http[^{UNICODE_SPACE}]+', '', 'g'))
        AS body_md5 FROM doc""",
)
def built_in_for_callback(spark, sf):
    """The per-value text function of the cleaning step, as a built-in expression."""
    linked = F.concat("body", F.lit(" https://x.example/"), "id", F.lit(" end"))
    return document_messages(spark, sf).select("id", F.md5(strip_urls(linked)).alias("body_md5"))


@query("p11_legacy_codes", "SELECT doc_id, CASE WHEN quality - 1 = -1 THEN 0 ELSE quality - 1 END AS sentiment FROM labels")
def legacy_codes(spark, sf):
    return table(spark, sf, "labels").select("doc_id", remap_legacy(F.col("quality") - 1).alias("sentiment"))


@query("p13_text_keys", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS body FROM orders")
def text_keys(spark, sf):
    orders = table(spark, sf, "orders")
    return conform(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("body"))).select("id", "body")


@query("p14_surrogate_ids", "SELECT item_id, sha256(CAST(item_id AS VARCHAR) || chr(31) || text) AS id FROM benchmark")
def surrogate_ids(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", surrogate_id(F.col("item_id"), F.col("text")).alias("id"))


@query("p15_constant_columns", "SELECT doc_id, DATE '2024-02-01' AS loaded, 'FIQA' AS source FROM documents")
def constant_columns(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.lit("2024-02-01").cast("date").alias("loaded"), F.lit("FIQA").alias("source")
    )


@query(
    "p16_renamed_aggregates",
    "SELECT lang AS ticker, avg(quality) AS sentiment, count(*) AS count FROM documents JOIN labels USING (doc_id) GROUP BY 1",
)
def renamed_aggregates(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return both.groupBy(F.col("lang").alias("ticker")).agg(F.avg("quality").alias("sentiment"), F.count(F.lit(1)).alias("count"))


@query(
    "p18_softmax",
    f"WITH {LOGITS_SQL} SELECT id, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM scored",
)
def softmax(spark, sf):
    pair = softmax_pair(F.col("l0"), F.col("l1"))
    return logit_pairs(spark, sf).select("id", F.round(pair[0], 6).alias("p0"), F.round(pair[1], 6).alias("p1"))


@query(
    "p19_sentiment_of_scores",
    f"""WITH {LOGITS_SQL} SELECT id, CASE WHEN abs(p0 - p1) < 0.05 THEN -69 WHEN p0 > p1 THEN 0 ELSE 1 END AS sentiment
        FROM scored""",
)
def sentiment_of_scores(spark, sf):
    pair = softmax_pair(F.col("l0"), F.col("l1"))
    return logit_pairs(spark, sf).select("id", sentiment_of_pair(pair[0], pair[1]).alias("sentiment"))


@query(
    "p20_truncated_tokens",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}$]+')[1:160] AS tokens FROM documents)
        SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t""",
)
def truncated_tokens(spark, sf):
    found = tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(found).alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("tokens_md5")
    )


@query(
    "p21_unknown_spam_code",
    f"WITH {DOC_SQL} SELECT id, coalesce(is_spam, -69) AS is_spam FROM doc",
)
def unknown_spam_code(spark, sf):
    from msgpulse.operators.curation import spam_code

    return spam_code(document_messages(spark, sf)).select("id", "is_spam")


@query("p22_symbol_column", "SELECT p_name AS ticker FROM part UNION ALL SELECT s_name FROM supplier")
def symbol_column(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_name").alias("Symbol"))
    makers = table(spark, sf, "supplier").select(F.col("s_name").alias("ACT Symbol"))
    return files.symbols(parts, makers)


@query("p23_ticker_from_path", f"WITH {EV_SQL} SELECT id, 'X-' || ticker || '.A' AS ticker FROM ev")
def ticker_from_path(spark, sf):
    """Plain CSV folders per ticker; the ticker is only in the path."""
    root = scratch_path(spark, "feed")
    named = event_messages(spark, sf).select("id", F.concat(F.lit("X-"), "ticker", F.lit(".A")).alias("tickers/t"))
    named.withColumnRenamed("tickers/t", "t").write.partitionBy("t").csv(f"{root}/tickers")
    raw = spark.read.schema("id string").option("recursiveFileLookup", True).csv(f"{root}/tickers")
    return raw.select("id", F.replace(files.ticker_from_path(), F.lit("t=")).alias("ticker"))


@query(
    "w1_first_per_text",
    f"""WITH {DOC_SQL} SELECT id, md5(body) AS body_md5, created_at FROM (
        SELECT *, row_number() OVER (PARTITION BY body ORDER BY created_at, id) AS r FROM doc) WHERE r = 1""",
)
def first_per_text(spark, sf):
    """Copies of a text reduced to the earliest."""
    first = dedup.first_message_per_text(document_messages(spark, sf))
    return first.select("id", F.md5("body").alias("body_md5"), "created_at")


@query(
    "w1_missing_bodies",
    f"""WITH {DOC_SQL}, m AS (SELECT * REPLACE (CASE WHEN likes % 3 = 0 THEN NULL ELSE body END AS body) FROM doc)
        SELECT id, md5(body) AS body_md5 FROM (
            SELECT *, row_number() OVER (PARTITION BY body ORDER BY created_at, id) AS r FROM m WHERE body IS NOT NULL) WHERE r = 1
        UNION ALL SELECT id, NULL FROM m WHERE body IS NULL""",
)
def missing_bodies(spark, sf):
    """Messages without a body are no copies of one another."""
    messages = document_messages(spark, sf).withColumn("body", F.when(F.col("likes") % 3 != 0, F.col("body")))
    return dedup.first_message_per_text(messages).select("id", F.md5("body").alias("body_md5"))


@query(
    "w1_first_per_id",
    f"""WITH {EV_SQL}, twice AS (SELECT * FROM ev UNION ALL SELECT * REPLACE ('again' AS body,
            created_at + (CASE WHEN likes % 2 = 0 THEN 1 ELSE -1 END) * INTERVAL 1 HOUR AS created_at) FROM ev)
        SELECT {EV_COLUMNS_SQL} FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, body) AS r FROM twice) WHERE r = 1""",
)
def first_per_id(spark, sf):
    """Every message twice, the copy now older, now younger than the original."""
    messages = event_messages(spark, sf)
    hours = F.when(F.col("likes") % 2 == 0, 1).otherwise(-1)
    again = messages.withColumns(
        {"body": F.lit("again"), "created_at": F.timestamp_micros(F.unix_micros("created_at") + hours * 3_600_000_000)}
    )
    return dedup.first_message_per_id(messages.unionByName(again))


@query(
    "w1_cleaned_corpus",
    f"""WITH {DOC_SQL}, copies AS (SELECT * FROM doc UNION ALL
            SELECT * REPLACE ('http://x.example/copy ' || body AS body, created_at + INTERVAL 1 DAY AS created_at) FROM doc)
        SELECT id, md5(regexp_replace(body, 'http[^{UNICODE_SPACE}]+', '', 'g')) AS body_md5, sentiment FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY source = 'FIQA', created_at) AS r FROM copies) WHERE r = 1""",
)
def cleaned_corpus(spark, sf):
    documents = document_messages(spark, sf).select(*MESSAGE_COLUMNS)
    copies = documents.withColumns(
        {
            "body": F.concat(F.lit("http://x.example/copy "), "body"),
            "created_at": F.col("created_at") + F.expr("INTERVAL 1 DAY"),
        }
    )
    corpus = combine.consolidated(documents, copies)
    return combine.cleaned(corpus, F.col("source") == "FIQA").select("id", F.md5("body").alias("body_md5"), "sentiment")


# --- filters on text ----------------------------------------------------------------


@query("f5_english_with_dollar", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND contains(text, '$')")
def english_with_dollar(spark, sf):
    return filters.english_with_cashtag(table(spark, sf, "documents")).select("doc_id", "n_chars")


@query("f6_phrase_matches", f"WITH {DOC_SQL} SELECT id FROM doc WHERE {_PHRASE_SQL}")
def phrase_matches(spark, sf):
    return filters.matching_phrases(document_messages(spark, sf), PHRASES).select("id")


@query("f6_phrase_index", f"WITH {DOC_SQL} SELECT id FROM doc WHERE {_PHRASE_SQL}")
def phrase_index(spark, sf):
    """The same phrases through the index of character runs."""
    # The labels grow with the documents: a shuffle join at every size.
    return phrases.matching(document_messages(spark, sf, "merge"), PHRASES).select("id")


@query(
    "f6_shipped_lexicon",
    f"""WITH {DOC_SQL}, seen AS (SELECT id, lower(body || CASE WHEN likes % 3 = 0 THEN ' News Digest' ELSE '' END) AS b FROM doc)
        SELECT id FROM seen WHERE contains(b, 'news digest') OR contains(b, 'trade alerts') OR contains(b, 'follow for')""",
)
def shipped_lexicon(spark, sf):
    """The shipped phrases, case-folded, over texts of which a third carry one of them."""
    from msgpulse.sources.lexicon import SPAM_PHRASES

    tail = F.when(F.col("likes") % 3 == 0, F.lit(" News Digest")).otherwise(F.lit(""))
    documents = document_messages(spark, sf).withColumn("body", F.concat("body", tail))
    return filters.matching_phrases(documents, SPAM_PHRASES, ignore_case=True).select("id")


@query("f6_shipped_index", f"""WITH {DOC_SQL}, seen AS (SELECT id, lower(body || CASE WHEN likes % 3 = 0 THEN ' News Digest' ELSE '' END) AS b FROM doc)
        SELECT id FROM seen WHERE contains(b, 'news digest') OR contains(b, 'trade alerts') OR contains(b, 'follow for')""")
def shipped_index(spark, sf):
    """The shipped phrases through the index of character runs, case-folded."""
    from msgpulse.sources.lexicon import SPAM_PHRASES

    tail = F.when(F.col("likes") % 3 == 0, F.lit(" News Digest")).otherwise(F.lit(""))
    documents = document_messages(spark, sf, "merge").withColumn("body", F.concat("body", tail))
    return phrases.matching(documents, SPAM_PHRASES, ignore_case=True).select("id")


@query(
    "f7_ham_classes",
    f"WITH {DOC_SQL} SELECT id, sentiment FROM doc WHERE is_spam = 0 AND sentiment IN (0, 1)",
)
def ham_classes(spark, sf):
    ham = filters.hams(document_messages(spark, sf))
    return filters.bulls(ham).unionByName(filters.bears(ham)).select("id", "sentiment")


# --- look-ups by id -----------------------------------------------------------------


@query("j1_not_in_training", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_in_training(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return keyed.rows_not_in(documents, table(spark, sf, "labels"), "doc_id")


@query("j2_rows_of_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id + 5 FROM labels)")
def rows_of_ids(spark, sf):
    ids = table(spark, sf, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return keyed.rows_in(table(spark, sf, "documents").select("doc_id", "lang"), ids, "doc_id")


@query(
    "j2_unmatched_ids",
    "SELECT count(*) AS n_unmatched FROM (SELECT DISTINCT doc_id * 3 AS i FROM labels) WHERE i NOT IN (SELECT doc_id FROM documents)",
)
def unmatched_ids(spark, sf):
    ids = table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    return keyed.unmatched_ids(ids, table(spark, sf, "documents"), "doc_id")


@query(
    "j3_flag_overlay",
    f"""WITH {DOC_SQL} SELECT id, CASE WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1) THEN 1
        WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) THEN 0 END AS is_spam FROM doc""",
)
def flag_overlay(spark, sf):
    labels = table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))
    documents = document_messages(spark, sf).select("id")
    return keyed.overlay_spam_flags(documents, labels.where("toxic = 1"), labels.where("quality = 1"))


@query(
    "j4_new_keys_only",
    f"WITH {EV_SQL} SELECT id, ticker FROM ev WHERE created_at >= '2024-01-16' OR created_at < '2024-01-03'",
)
def new_keys_only(spark, sf):
    messages = event_messages(spark, sf)
    stored = messages.where("created_at >= '2024-01-03' AND created_at < '2024-01-16'")
    path = scratch_path(spark, "messages")
    sinks.write_parquet(stored, path)
    return keyed.absent_from(messages, sinks.read_messages(spark, path)).select("id", "ticker")


@query(
    "j5_assigned_predictions",
    f"WITH {DOC_SQL} SELECT id, coalesce(sentiment, CAST(likes % 2 AS INTEGER)) AS sentiment FROM doc",
)
def assigned_predictions(spark, sf):
    messages = document_messages(spark, sf).select("id", "sentiment", "likes")
    predicted = filters.unlabelled(messages).select(
        "id", (F.col("likes") % 2).cast("int").alias("sentiment"), F.lit("v1").alias("model_version")
    )
    return keyed.with_predictions(messages, predicted).select("id", "sentiment")


# --- set operations and distinct ----------------------------------------------------


@query("a9_distinct_symbols", "SELECT DISTINCT p_brand AS ticker FROM part")
def distinct_symbols(spark, sf):
    return aggregates.distinct_symbols(table(spark, sf, "part").withColumnRenamed("p_brand", "ticker"))


@query(
    "a7_mean_of_scores",
    """SELECT vec_id, round(m, 6) AS mean, CASE WHEN abs(m) < 0.05 THEN -69 WHEN m >= 0.05 THEN 1
       WHEN m IS NOT NULL THEN 0 END AS sentiment
       FROM (SELECT vec_id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) AS m FROM embeddings)""",
)
def mean_of_scores(spark, sf):
    mean = mean_score(F.col("embedding"))
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(mean, 6).alias("mean"), sentiment_of_mean(mean).alias("sentiment")
    )


@query("u1_concatenated_files", "SELECT user_id, value FROM events UNION ALL SELECT user_id, value FROM events")
def concatenated_files(spark, sf):
    return files.parquet_corpus(spark, f"{sf}/events.parquet", f"{sf}/events.parquet").select("user_id", "value")


@query(
    "u2_aligned_by_name",
    f"""WITH {EV_SQL}, {DOC_SQL} SELECT id, md5(body) AS body_md5, author, sentiment, likes, ticker, NULL::INTEGER AS is_spam FROM ev
        UNION ALL SELECT id, md5(body), author, sentiment, likes, ticker, is_spam FROM doc""",
)
def aligned_by_name(spark, sf):
    united = combine.union_by_name(event_messages(spark, sf), document_messages(spark, sf))
    return united.select("id", F.md5("body").alias("body_md5"), "author", "sentiment", "likes", "ticker", "is_spam")


@query(
    "u3_union_of_ids",
    "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM documents WHERE lang = 'de'",
)
def union_of_ids(spark, sf):
    labels, documents = table(spark, sf, "labels"), table(spark, sf, "documents")
    return keyed.union_ids(
        labels.where("toxic = 1"), labels.where("quality = 1"), documents.where("lang = 'de'"), key="doc_id"
    )


@query(
    "u5_bulls_and_bears",
    f"WITH {EV_SQL} SELECT id, sentiment FROM ev WHERE sentiment = 1 UNION ALL SELECT id, sentiment FROM ev WHERE sentiment = 0",
)
def bulls_and_bears(spark, sf):
    messages = event_messages(spark, sf).select("id", "sentiment")
    return combine.union_by_name(filters.bulls(messages), filters.bears(messages))


@query("u6_difference_by_id", f"WITH {EV_SQL} SELECT id, ticker FROM ev WHERE id NOT IN (SELECT id FROM ev WHERE sentiment = 1)")
def difference_by_id(spark, sf):
    messages = event_messages(spark, sf)
    return keyed.rows_not_in(messages.select("id", "ticker"), filters.bulls(messages).select("id"))


@query("t6_random_order", f"WITH {DOC_SQL} SELECT id, md5('shuffle' || id) AS position FROM doc ORDER BY 2, 1")
def random_order(spark, sf):
    ordered = ranking.shuffled(document_messages(spark, sf).select("id"))
    return ordered.withColumn("position", F.md5(F.concat(F.lit("shuffle"), "id")))


@query(
    "t2_first_trusted_rows",
    f"WITH {DOC_SQL} SELECT id, source, created_at FROM doc WHERE sentiment IS NOT NULL ORDER BY created_at, id LIMIT 4242",
)
def first_trusted_rows(spark, sf):
    labelled = filters.labelled(document_messages(spark, sf)).select("id", "source", "created_at")
    return ranking.first_n(labelled, [F.col("created_at"), F.col("id")], 4242)
