"""Per-ticker SQLite stores as a Spark source, and their export.

``spark.read.format("message_stores").load(root)`` scans every ``*.db`` below a
root on a mounted path. The ticker is the store's folder name. A store larger
than ``split_bytes`` is cut into row-id ranges, so one big store is read by many
tasks, and small stores are packed together; equality filters on ticker skip whole stores, and filters on sentiment
and creation day run inside SQLite.
"""

from __future__ import annotations

import glob
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

from msgpulse.session import local_form

_SCHEMA = (
    "id STRING, body STRING, author STRING, created_at STRING, sentiment INT, source STRING, "
    "likes BIGINT, replies BIGINT, ticker STRING"
)
_ARROW = pa.schema(
    [
        ("id", pa.string()),
        ("body", pa.string()),
        ("author", pa.string()),
        ("created_at", pa.string()),
        ("sentiment", pa.int32()),
        ("source", pa.string()),
        ("likes", pa.int64()),
        ("replies", pa.int64()),
        ("ticker", pa.string()),
    ]
)
_BATCH_ROWS = 8192
# Weight of opening a store when small stores are packed into one task.
_OPEN_COST = 4 << 20
_DAY_OPERATORS = {GreaterThan: ">=", GreaterThanOrEqual: ">=", LessThan: "<=", LessThanOrEqual: "<="}

# The layout of a store.
_CREATE = """CREATE TABLE IF NOT EXISTS messages (
    id text PRIMARY KEY, body text NOT NULL, author text NOT NULL, created_at timestamp NOT NULL,
    sentiment, source NOT NULL, likes DEFAULT 0, replies DEFAULT 0)"""


@dataclass
class StoreRanges(InputPartition):
    """One task's share: whole small stores, or one row-id range of a large store."""

    ranges: list[tuple[str, int | None, int | None]]


class MessageStoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = local_form(options["path"])
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.split_rows = int(options.get("split_rows", 250_000))
        self.tickers: set | None = None
        self.conditions: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        """Take what SQLite or the folder names can answer; Spark re-checks the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ticker",):
                wanted = {f.value}
                self.tickers = wanted if self.tickers is None else self.tickers & wanted
            elif isinstance(f, EqualTo) and f.attribute == ("sentiment",):
                self.conditions.append(("CAST(sentiment AS INTEGER) = ?", [f.value]))
            elif isinstance(f, IsNull) and f.attribute == ("sentiment",):
                self.conditions.append(("sentiment IS NULL", []))
            elif type(f) in _DAY_OPERATORS and f.attribute == ("created_at",) and len(str(f.value)) >= 10:
                self.conditions.append((f"substr(created_at, 1, 10) {_DAY_OPERATORS[type(f)]} ?", [str(f.value)[:10]]))
            yield f

    def partitions(self):
        parts, pack, packed = [], [], 0
        for path in sorted(glob.glob(os.path.join(self.root, "**", "*.db"), recursive=True)):
            if self.tickers is not None and _ticker_of(path) not in self.tickers:
                continue
            size = os.path.getsize(path)
            if size <= self.split_bytes:
                if pack and packed + size + _OPEN_COST > self.split_bytes:
                    parts.append(StoreRanges(pack))
                    pack, packed = [], 0
                pack, packed = [*pack, (path, None, None)], packed + size + _OPEN_COST
                continue
            with _open(path) as conn:
                lowest, highest = conn.execute("SELECT min(rowid), max(rowid) FROM messages").fetchone()
            for lo in range(lowest or 0, (highest or 0) + 1, self.split_rows):
                parts.append(StoreRanges([(path, lo, lo + self.split_rows)]))
        return [*parts, StoreRanges(pack)]

    def read(self, partition: StoreRanges) -> Iterator[pa.RecordBatch]:
        for path, lo, hi in partition.ranges:
            yield from self._read_store(path, lo, hi)

    def _read_store(self, path: str, lo: int | None, hi: int | None) -> Iterator[pa.RecordBatch]:
        where, values = [c for c, _ in self.conditions], [v for _, vs in self.conditions for v in vs]
        if lo is not None:
            where.append("rowid >= ? AND rowid < ?")
            values += [lo, hi]
        # Named columns: stores of different age order their columns differently.
        statement = (
            "SELECT CAST(id AS TEXT), CAST(body AS TEXT), CAST(author AS TEXT), CAST(created_at AS TEXT), "
            "CAST(sentiment AS INTEGER), CAST(source AS TEXT), CAST(likes AS INTEGER), CAST(replies AS INTEGER) "
            "FROM messages" + (" WHERE " + " AND ".join(where) if where else "")
        )
        ticker = _ticker_of(path)
        with _open(path) as conn:
            cursor = conn.execute(statement, values)
            while rows := cursor.fetchmany(_BATCH_ROWS):
                columns = [*zip(*rows), [ticker] * len(rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(columns, _ARROW)], schema=_ARROW
                )


class MessageStores(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_stores"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> MessageStoreReader:
        return MessageStoreReader(self.options)


class _open:
    """Read-only connection that is closed on exit."""

    def __init__(self, path: str):
        self.conn = sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def __enter__(self):
        return self.conn

    def __exit__(self, *_):
        self.conn.close()


def _ticker_of(path: str) -> str:
    return os.path.basename(os.path.dirname(path))


def store_corpus(spark: SparkSession, root: str, **options) -> DataFrame:
    """All stores below a root; ``created_at`` stays text until it is conformed."""
    spark.dataSource.register(MessageStores)
    return spark.read.format(MessageStores.name()).options(**options).load(root)
