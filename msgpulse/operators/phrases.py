"""Phrase look-up through an index, for phrase lists too long for one ``contains`` per phrase.

A text holds a phrase when the phrase is a substring of it, as ``contains`` has it. Whole words
cannot key such a look-up ("free" is inside "freedom"), but character runs can: every text that
holds a phrase holds each of its runs of ``q`` characters. So each phrase is filed under its
rarest run (the whole phrase if shorter than ``q``), rarity counted over all texts; the texts'
runs meet the filed ones in an equi-join, whose matches are stored (and give that rarity), and a
literal ``contains`` confirms each candidate.

The work grows with the characters of the texts and the candidates, not with texts times
phrases. The filed runs are stored, so Spark knows their size: it sends a short list to every
task and shuffles ids and runs for a long one. Texts never travel with their runs; each meets
its candidates once, by its row id. Nothing but the few distinct run lengths reaches the driver.
An empty phrase is in every text that is not null. Null texts hold nothing; null phrases are
dropped. Repeated phrases count once; repeated rows are kept as rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.session import materialise

Q = 4


def _runs(text: Column, length: int) -> Column:
    """Distinct runs of ``length`` characters of a text (none if it is shorter)."""
    # One pass over the text; substring(text, i, n) would count from its start for every run.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))."), F.lit(1)))


def phrase_table(phrases: Sequence[str] | DataFrame, spark) -> DataFrame:
    if isinstance(phrases, DataFrame):
        return phrases.select(F.col(phrases.columns[0]).cast("string").alias("phrase"))
    return spark.createDataFrame([(p,) for p in phrases], "phrase STRING")


def _holding(texts: DataFrame, phrases: Sequence[str] | DataFrame, text: str, ignore_case: bool, q: int) -> DataFrame:
    """The rows of ``texts`` holding a phrase, with ``_phrases``: all they hold."""
    fold = F.lower if ignore_case else (lambda c: c)
    wanted = materialise(
        phrase_table(phrases, texts.sparkSession)
        .where(F.col("phrase").isNotNull())
        .select(fold(F.col("phrase")).alias("phrase"))
        .distinct()
        .withColumn("width", F.least(F.length("phrase"), F.lit(q))),
        "phrases",
    )
    body = texts.select("_row", fold(F.col(text)).alias("_text")).where(F.col("_text").isNotNull())
    widths = sorted(r["width"] for r in wanted.select("width").distinct().collect())  # at most q + 1 values
    found = []
    if 0 in widths:  # the empty phrase is in every text
        found.append(body.select("_row", F.lit("").alias("phrase")))
    for width in [w for w in widths if w > 0]:
        filed = materialise(
            wanted.where(F.col("width") == width).select("phrase", F.explode(_runs(F.col("phrase"), width)).alias("run")),
            "phrase-runs",
        )
        # Which texts have which of the filed runs: rarity and candidates are both taken from it, so
        # that the runs of the texts are made once.
        seen = body.select("_row", F.explode(_runs(F.col("_text"), width)).alias("run"))
        postings = materialise(seen.join(filed.select("run").distinct(), "run", "left_semi"), "phrase-postings", "zstd")
        counts = postings.groupBy("run").count()
        keys = materialise(
            filed.join(counts, "run", "left")
            .groupBy("phrase")
            .agg(F.min_by("run", F.struct(F.coalesce("count", F.lit(0)), F.col("run"))).alias("run")),
            "phrase-keys",
        )
        found.append(postings.join(keys, "run").select("_row", "phrase"))
    if not found:
        return texts.withColumn("_phrases", F.array().cast("array<string>")).limit(0)
    # A row's candidates come together, so that its text is shuffled once, not once per candidate.
    candidates = reduce(DataFrame.unionByName, found).groupBy("_row").agg(F.collect_list("phrase").alias("_phrases"))
    literal = F.filter("_phrases", lambda phrase: F.contains(F.col("_text"), phrase))
    return (
        texts.join(candidates, "_row")
        .withColumn("_text", fold(F.col(text)))
        .withColumn("_phrases", literal)
        .where(F.size("_phrases") > 0)
        .drop("_text")
    )


def phrase_hits(
    texts: DataFrame, phrases: Sequence[str] | DataFrame, text: str = "body", ignore_case: bool = False, q: int = Q
) -> DataFrame:
    """``_row`` of every text holding a phrase, with the phrase; ``texts`` must carry ``_row``."""
    return _holding(texts, phrases, text, ignore_case, q).select("_row", F.explode("_phrases").alias("phrase"))


def matching(messages: DataFrame, phrases: Sequence[str] | DataFrame, ignore_case: bool = False, q: int = Q) -> DataFrame:
    """The rows of ``messages`` whose ``body`` holds any phrase: the rows of ``contains_any``."""
    # Stored, so that a row has the same id in every use (behind a shuffle it may change from run to
    # run) and what stands above runs once.
    keyed = materialise(messages.withColumn("_row", F.monotonically_increasing_id()), "phrase-texts", "zstd")
    return _holding(keyed, phrases, "body", ignore_case, q).drop("_row", "_phrases")
