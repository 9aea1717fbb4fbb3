"""The named queries of this folder, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.llm import alignment, attention, html, jaccard, mixing, packing, pii, quality, records, spans, topk, toxicity, whitening
from msgpulse.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Explicit schemas, so that opening a table reads no file.
TABLES = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if it has one."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            SQL[query.__name__] = sql
        return query

    return add


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@registered()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a packed sequence."""
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


@registered(
    """
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
               md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS key
        FROM documents),
    sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
    ranked AS (
        SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS DOUBLE) AS weight,
               CAST(3 * source_size AS DOUBLE) AS stop, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank
        FROM sums),
    filled AS (
        SELECT *, sum(CAST(source_size AS DOUBLE)) OVER () AS whole,
               coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
               sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS waiting,
               row_number() OVER (ORDER BY stop / weight, rank) AS place
        FROM ranked),
    levels AS (SELECT *, (whole - filled) / waiting AS level FROM filled),
    opened AS (SELECT min(place) AS open_from FROM levels WHERE level * weight <= stop),
    final AS (SELECT level AS final, open_from FROM levels, opened WHERE place = open_from),
    targets AS (
        SELECT source, source_size, CASE WHEN place < open_from THEN stop ELSE final * weight END AS target
        FROM levels, final),
    placed AS (
        SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
        FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
                + greatest(0, least(budget % source_size - begin, size)) END::BIGINT AS taken
    FROM placed
    """
)
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix of all sources takes."""
    return mixing.mixed(table(spark, sf_dir, "documents"), carry=("doc_id",))


@registered()
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and likelihood ratio of every document."""
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered()
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@registered()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the training part of the labels."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered()
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    spans = pii.found_in(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    base = F.filter("spans", lambda span: span["base"])
    written = lambda found: F.array_join(
        F.transform(found, lambda span: F.concat_ws(":", span["kind"], span["start"], span["end"])), ","
    )
    count = lambda kind: F.size(F.filter(base, lambda span: span["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written("spans").alias("spans"),
    )


@registered(
    """
    WITH ints AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS terms FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    one AS (SELECT vec_id, min(terms) AS terms FROM ints GROUP BY vec_id),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(list_zip(q.terms, c.terms), lambda t: t[1] * t[2]))::BIGINT AS score
        FROM one q JOIN one c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
    WHERE rank <= 20
    """
)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@registered()
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages"))


@registered()
def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the record files."""
    path = scratch_path(spark, "records")
    records.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return records.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@registered()
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat elsewhere."""
    return spans.without_repeats(table(spark, sf_dir, "documents"))


@registered()
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 whitened components of every usable vector, by an incremental eigendecomposition."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@registered()
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document, with corpus-wide pair counts."""
    return alignment.aligned(
        table(spark, sf_dir, "documents"),
        vocabulary("byte_bpe_50k.json"),
        vocabulary("piece_bpe_32k.model"),
        a_ranks=vocabulary("byte_bpe_50k.tiktoken"),
    )


@registered()
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by gated attention over its passages, learned from the training fold."""
    return attention.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
