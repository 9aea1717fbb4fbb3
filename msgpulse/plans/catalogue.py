"""Registry of named queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpulse.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def zoneless(df: DataFrame) -> DataFrame:
    """UTC timestamps as zone-less ones, the type the comparison engine returns."""
    stamps = {
        f.name: F.col(f"`{f.name}`").cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)
    }
    return df.withColumns(stamps) if stamps else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` it has no SQL form and is tested otherwise."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return zoneless(build(prepare(spark), sf_dir))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register
