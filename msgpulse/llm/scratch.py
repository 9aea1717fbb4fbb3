"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from msgpulse.session import scratch_path


def stored(df: DataFrame, label: str, *by: str, compression: str = "zstd") -> DataFrame:
    """Write a table once to the shared folder and read it back.

    It cuts lineage without depending on any executor, runs what stands above once however
    often the result is read, and gives the optimizer exact sizes. ``by`` names partition columns.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
