"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions alone.

Method: two multinomials over hashed n-grams, one of trusted documents and one of the whole raw
corpus. A document's score is the mean over its n-grams of log p_trusted - log p_raw, so length
does not matter, and every document meets the same threshold. The n-grams are whole words and
pairs of whole words, each hashed into one of ``buckets`` (32,768).

Counting reduces inside each task to at most ``buckets`` rows. Every document labelled of quality 1
is trusted, however many there are: their ids meet the documents in a shuffle. The raw counts cover
every document, without a join. The weights, one number per bucket and so of fixed size, reach the
tasks as one constant array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored

_SPACE = " \t\n\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """The text with every ASCII white space as a space; literal replacements are far cheaper than patterns."""
    for space in _SPACE[1:]:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Runs without ASCII white space; a missing or blank text has none."""
    return F.array_remove(F.split(_spaced(F.coalesce(text, F.lit(""))), " "), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _windows(hashes: Column, width: int) -> Column:
    """A hash of each window of ``width`` words."""
    return F.transform(_positions(F.size(hashes) - width + 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))


def _placed(windows: Column) -> Column:
    """Windows as sorted (hash, start) pairs; none where no hash repeats, as in most texts."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def _again(placed: Column) -> Column:
    """Starts of the windows whose hash stands twice in the sorted (hash, start) pairs."""
    same = lambda x, j: F.coalesce(F.get(placed, j)["h"] == x["h"], F.lit(False))
    found = F.filter(placed, lambda x, j: same(x, j - 1) | same(x, j + 1))
    return F.sort_array(F.transform(found, lambda x: x["i"]))


def _covered(starts: Column, width: int) -> Column:
    """Words inside windows at these starts, each word once."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n"), (i + width).alias("end")
        ),
        lambda acc: acc["n"],
    )


def _grams(before: Column, word: Column, buckets: int) -> list[Column]:
    """Buckets of a word and of the pair it makes with the word before; the first word pairs with the start.
    Both arguments are word hashes."""
    return [F.pmod(hashed, F.lit(buckets)).cast("int") for hashed in (word, F.xxhash64(before, word, F.lit(2)))]


def trusted_ids(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Every id of quality 1, as often as it is labelled so."""
    return labels.where((F.col("quality") == 1) & F.col(id_column).isNotNull()).select(F.col(id_column).alias("good_id"))


def _counted(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    """How often each bucket is met in these texts."""
    return (
        texts.select(F.transform(words(F.col("text")), lambda word: F.xxhash64(word)).alias("hashes"))
        .select("hashes", F.explode(_positions(F.size("hashes"))).alias("i"))
        .select(F.explode(F.array(*_grams(F.get("hashes", F.col("i") - 1), F.get("hashes", "i"), buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias(name))
    )


def ratios(documents: DataFrame, trusted: DataFrame, buckets: int, smoothing: float) -> Column:
    """Log p_trusted - log p_raw of each bucket, in order, as one constant array."""
    spark = documents.sparkSession
    # The labels grow with the documents: a shuffle join at every size. A semi join counts a document once.
    good = documents.join(trusted.hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi")
    counts = stored(
        spark.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(_counted(documents, buckets, "raw"), "bucket", "left")
        .join(_counted(good, buckets, "good"), "bucket", "left")
        .fillna(0, ["raw", "good"]),
        "ngrams",
    )
    sums = counts.agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good")).first()
    share = lambda n, total: (F.col(n) + smoothing) / F.lit(float(total) + smoothing * buckets)
    ratio = F.log(share("good", sums["all_good"])) - F.log(share("raw", sums["all_raw"]))
    ratio = ratio if sums["all_good"] else F.lit(0.0)
    in_order = counts.select("bucket", F.format_string("%.4f", ratio).alias("ratio")).orderBy("bucket").collect()
    return F.split(F.lit(",".join(row["ratio"] for row in in_order)), ",").cast("array<double>")


def judged(
    documents: DataFrame,
    labels: DataFrame,
    buckets: int = 1 << 15,
    smoothing: float = 1.0,
    threshold: float = -0.3,
    min_words: int = 50,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    A missing text is an empty one: no words, score 0, base failed. Trusted are all labelled
    documents of quality 1; with none the score is 0 for every document. Repeated rows are judged one by one and alike; a missing id is kept; further columns are
    left out; an empty table gives no rows.
    """
    texts = documents.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    weights = ratios(texts, trusted_ids(labels), buckets, smoothing)
    text, found = F.col("text"), F.col("words")
    hashes = F.col("hashes")
    total = F.aggregate(
        _positions(F.size(hashes)),
        F.lit(0.0),
        lambda acc, i: sum((F.get(weights, b) for b in _grams(F.get(hashes, i - 1), F.get(hashes, i), buckets)), acc),
    )
    return (
        texts.select("doc_id", "text", words(text).alias("words"))
        .select(
            "doc_id",
            "text",
            F.transform(found, lambda word: F.xxhash64(word)).alias("hashes"),
        )
        .select(
            "doc_id",
            F.size("hashes").cast("bigint").alias("n_words"),
            F.length(F.replace(_spaced(text), F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            duplicate_lines(text).alias("n_dup_lines"),
            _windows(F.col("hashes"), 3).alias("windows"),
            F.when(F.size(hashes) > 0, total / (2 * F.size(hashes))).otherwise(0.0).alias("score"),
        )
        .withColumn("placed", _placed(F.col("windows")))
        .withColumn("n_repeat_words", _covered(_again(F.col("placed")), 3).cast("bigint"))
        .withColumn(
            "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        )
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .drop("windows", "placed")
    )
