"""Class-balanced sampling and hash splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgpulse.functions.hashing import order_hash, unit_hash
from msgpulse.schema import BEARISH, BULLISH

# Four hex digits: at most 65,536 histogram cells per class.
_CELL_DIGITS = 4


def balance_marked(
    rows: DataFrame,
    share: float = 0.75,
    salt: str = "balance",
    label: str = "sentiment",
    size: int | None = None,
    mark: str = "chosen",
) -> DataFrame:
    """Mark exactly N rows of each class, the ones with the smallest (hash, id).

    N is ``size``, or ``floor(share * bearish rows)``. Nothing is ranked globally:
    a histogram of hash prefixes finds the cell in which each class reaches N, only
    that cell (1/65,536 of a class) is ranked to find the last chosen (hash, id),
    and a final pass compares every row with its class's threshold. The first two
    passes read id and label only. ``rows`` must be unique by id. A class with
    fewer than N rows is an error at run time, like drawing more than there is.
    """
    classes = rows.where(F.col(label).isin(BULLISH, BEARISH)).select(
        F.col(label).alias("_label"), F.col("id").alias("_id"), order_hash(salt, F.col("id")).alias("_hash")
    )
    # Hex digits of equal number sort as text like the numbers they stand for.
    cell = F.substring("_hash", 1, _CELL_DIGITS)

    histogram = classes.groupBy("_label", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    per_class = Window.partitionBy("_label")
    if size is None:
        bearish = F.sum(F.when(F.col("_label") == BEARISH, F.col("_n")).otherwise(0)).over(Window.partitionBy())
        wanted = F.floor(bearish * F.lit(share)).cast("long")
    else:
        wanted = F.lit(size).cast("long")
    checked = F.when(F.sum("_n").over(per_class) >= F.col("_want"), F.col("_want")).otherwise(
        F.raise_error(F.lit("a class is smaller than the balanced sample size")).cast("long")
    )
    # Below: one row per class each, so these broadcasts do not grow with the data.
    cuts = (
        histogram.withColumn("_want", wanted)
        .withColumns({"_want": checked, "_upto": F.sum("_n").over(per_class.orderBy("_cell"))})
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select("_label", "_cell", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    thresholds = (
        classes.withColumn("_cell", cell)
        .join(F.broadcast(cuts), ["_label", "_cell"])
        .withColumn("_rank", F.row_number().over(per_class.orderBy("_hash", "_id")))
        .where(F.col("_rank") == F.col("_left"))
        .select("_label", F.col("_hash").alias("_last_hash"), F.col("_id").alias("_last_id"))
    )
    # One comparison, so that a row is hashed once; rows of no class meet NULLs, which
    # sort before everything, and are not chosen.
    own = F.struct(order_hash(salt, F.col("id")).alias("_last_hash"), F.col("id").alias("_last_id"))
    return (
        rows.join(F.broadcast(thresholds), F.col(label) == F.col("_label"), "left")
        .withColumn(mark, own <= F.struct("_last_hash", "_last_id"))
        .drop("_label", "_last_hash", "_last_id")
    )


def balanced_sample(
    rows: DataFrame,
    share: float = 0.75,
    salt: str = "balance",
    label: str = "sentiment",
    size: int | None = None,
) -> DataFrame:
    """Exactly N rows of each class without replacement."""
    return balance_marked(rows, share, salt, label, size, "_chosen").where("_chosen").drop("_chosen")


def split_of(
    rows: DataFrame, parts: Sequence[tuple[str, float]], salt: str = "split", key: str = "id", column: str = "part"
) -> DataFrame:
    """Assign every row to a named part by hash, without a shuffle.

    ``parts`` are (name, share) in order; the last takes what remains.
    """
    position = unit_hash(salt, F.col(key))
    upto, assigned = 0.0, None
    for name, share in parts[:-1]:
        upto += share
        within = position < F.lit(upto)
        assigned = F.when(within, F.lit(name)) if assigned is None else assigned.when(within, F.lit(name))
    last = F.lit(parts[-1][0])
    return rows.withColumn(column, last if assigned is None else assigned.otherwise(last))


# --- fixed values: part sizes (three quarters, then three quarters of the rest) ---
SPAM_PARTS = (("train", 0.75), ("test", 0.1875), ("val", 0.0625))
REST_PARTS = (("test", 0.75), ("val", 0.25))
# ----------------------------------------------------------------------------------


def spam_split(rows: DataFrame, salt: str = "split") -> DataFrame:
    return split_of(rows, SPAM_PARTS, salt)


def rest_split(rows: DataFrame, salt: str = "split") -> DataFrame:
    return split_of(rows, REST_PARTS, salt)
