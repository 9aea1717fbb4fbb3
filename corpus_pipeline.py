"""From raw documents to packed training sequences, stage by stage.

Every stage reads what the one before kept, as written Parquet, and returns the columns of
``documents`` again; the last returns packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.llm import jaccard, mixing, packing, pii, toxicity
from msgpulse.llm.queries import table, vocabulary
from msgpulse.llm.scratch import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    scored = toxicity.scored(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document that names it stays; of repeated rows, one."""
    classes = jaccard.near_copies(docs.select("doc_id", "text"))
    # Ids that stay: those that name their class. A missing id stays only if its class has no other.
    kept = stored(classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("kept")).distinct(), "kept")
    return (
        docs.select(*COLUMNS)
        .join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi")
        .dropDuplicates(["doc_id", "text"])
        .select(*COLUMNS)
    )


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; no document goes."""
    found = pii.found_in(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"))
    text = F.col("masked")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that is taken in part is cut to its first words."""
    mix = mixing.mixed(docs.select(*COLUMNS), carry=COLUMNS)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1)
    copies = F.concat(
        F.array_repeat(F.lit(-1).cast("bigint"), times.cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")),
    )
    words = F.split(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < 0, F.col("text")).otherwise(cut)
    return mix.withColumn("words", F.explode(copies)).select(
        "doc_id", text.alias("text"), "lang", "source", F.length(text).cast("bigint").alias("n_chars")
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    pieces = packing.packed(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near copies", one_of_near_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]

#: Grammar, random field and tokenizer have no SQL form; tests compare with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
