"""Move an old message table to the current layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgpulse.functions.labels import sentinel_to_null
from msgpulse.schema import conform


def migrated(old: DataFrame) -> DataFrame:
    """Current layout by name, with the uncertain code turned into NULL.

    ``migrate_table`` writes the result to a new path; the old one stays as the backup.
    """
    return conform(old).withColumn("sentiment", sentinel_to_null(F.col("sentiment")))


def migrate_table(spark: SparkSession, old_path: str, new_path: str) -> tuple[DataFrame, DataFrame]:
    """Write the current layout of a stored table to ``new_path``; both tables as read back."""
    migrated(spark.read.parquet(old_path)).write.parquet(new_path)
    return spark.read.parquet(old_path), spark.read.parquet(new_path)
