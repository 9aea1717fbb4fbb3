"""Mixing sources to target weights, in SQL functions alone.

Method: every document gets a random key (a salted hash), sources are range-sorted by that key,
distributed prefix sums of the sizes place each document on its source's line of words, and each
source is cut at its exact budget, in as many epochs as it takes.

The prefix sums are taken in cells: a cell is a range of the random key within a source. A source
of n rows has about sqrt(n) cells of about sqrt(n) rows, so that neither the rows of a cell nor the
cells of a source ever meet in numbers that one task cannot hold, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored

_SPACE = " \t\n\x0b\x0c\r"
#: Hex digits of the key that decide its cell.
_DIGITS = 8


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; a missing text has none."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    runs = F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(runs).cast("bigint")


def targets(sizes: DataFrame, epochs: int = 3) -> DataFrame:
    """Target size of each (source, source_size, weight).

    The shares of all words go by weight; a source stops at ``epochs`` times its size and what
    it cannot take is shared again by weight among the others, until none is above its stop.
    Sources ordered by stop / weight fill in that order, so the whole sharing is one pass: with
    the first k sources full, the level of the others is (all - stops of k) / (weights after k).
    """
    by_level = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("whole") - F.col("filled")) / F.col("waiting")
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.col("place"))).over(everything)
    return (
        sizes.withColumn("stop", F.lit(float(epochs)) * F.col("source_size"))
        .withColumn("whole", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("filled", F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
        .withColumn("waiting", F.sum("weight").over(after))
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("level", level)
        .withColumn("open_from", F.coalesce(first_open, F.lit(2**31 - 1)))
        .withColumn("final", F.max(F.when(F.col("place") == F.col("open_from"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("place") < F.col("open_from"), F.col("stop")).otherwise(F.col("final") * F.col("weight")),
        )
    )


def mixed(
    documents: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    epochs: int = 3,
    salt: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The ``carry`` columns (all by default) with ``size, source_size, target, taken``.

    ``taken`` is how many of the document's words the mix takes: whole epochs of its source, then
    a further one in random order up to the budget, where one document may be taken in part.
    Sources stand by code point, a missing one last, and the weights repeat in that order. A
    missing or empty text has size 0 and takes 0; a missing id is a value like any other; rows
    equal in id and text are interchangeable; an empty table gives no rows. Columns of the input
    with one of the four names are replaced.
    """
    made = ("size", "source_size", "target", "taken")
    carried = [name for name in (documents.columns if carry is None else carry) if name not in made]
    parts = [F.lit(salt), F.col(id_column).cast("string"), F.md5(F.col(text_column).cast("binary"))]
    keyed = documents.select(
        F.struct(*carried).alias("row"),
        F.col(source_column).alias("source"),
        F.md5(F.concat_ws(":", *[F.coalesce(part, F.lit("")) for part in parts]).cast("binary")).alias("key"),
        n_words(F.col(text_column)).alias("size"),
    )
    rows = stored(keyed, "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    share = F.array(*[F.lit(float(weight)) for weight in weights])
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.get(share, ((F.col("rank") - 1) % len(weights)).cast("int"))
    )
    budgets = stored(
        targets(ranked, epochs).select(
            F.col("source").alias("of"), "source_size", "target", F.ceil(F.sqrt("n_rows")).alias("cells")
        ),
        "mix-targets",
    )
    part = F.conv(F.substring("key", 1, _DIGITS), 16, 10).cast("bigint") * F.col("cells")
    celled = rows.join(budgets, F.col("source").eqNullSafe(F.col("of"))).withColumn(
        "cell", F.shiftright(part, 4 * _DIGITS)
    )
    until = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        celled.groupBy("source", "cell")
        .agg(F.sum("size").alias("cell_size"))
        .select(
            F.col("source").alias("base_of"),
            F.col("cell").alias("base_at"),
            F.coalesce(F.sum("cell_size").over(until), F.lit(0)).alias("base"),
        )
    )
    inside = Window.partitionBy("source", "cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("whole") * F.col("source_size") - F.col("begin")
    return (
        celled.join(bases, F.col("source").eqNullSafe(F.col("base_of")) & (F.col("cell") == F.col("base_at")))
        .withColumn("begin", begin)
        .withColumn("whole", whole)
        .withColumn("taken", F.col("whole") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size"))))
        .select("row.*", "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))
    )
