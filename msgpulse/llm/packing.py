"""Best-fit packing of tokenized documents into sequences of fixed length.

Method: bounded-space online best fit. Each task keeps a fixed number of open bins, found
through a bitset keyed by free space: a piece goes to the bin it fills best, and when it fits
nowhere and all bins are open, the fullest closes. The rows of a bin are held until it closes,
so a task holds at most ``bins * capacity`` ids. What is still open when a task ends is packed
once more in far fewer tasks, longest piece first, so that small tasks waste nothing.

Tokens, not rows, bound every task of the second round; no group of documents matters, as any
piece may go anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored
from msgpulse.llm.tokens import encoder

PACKED = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids BINARY, sequence_id BIGINT, offset BIGINT"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
_ID_BYTES = 4
_ROWS_OUT = 4096


class OpenBins:
    """A bounded set of open bins; ``place`` and ``drain`` hand back rows of closed ones."""

    def __init__(self, capacity: int, bins: int, first_id: int):
        self._capacity, self._most, self._next = capacity, bins, first_id
        self._by_free: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
        self._bits = 0
        self._open = 0

    def place(self, row: tuple, length: int) -> list[tuple]:
        fitting = self._bits >> length
        closed: list[tuple] = []
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence, rows = self._take(free)
        else:
            if self._open == self._most:
                closed = self._take((self._bits & -self._bits).bit_length() - 1)[1]
            free, sequence, rows = self._capacity, self._next, []
            self._next += 1
        rows.append((*row, sequence, self._capacity - free))
        if free == length:
            return closed + rows
        self._by_free[free - length].append((sequence, rows))
        self._bits |= 1 << (free - length)
        self._open += 1
        return closed

    def drain(self) -> Iterator[tuple]:
        while self._bits:
            yield from self._take((self._bits & -self._bits).bit_length() - 1)[1]

    def _take(self, free: int) -> tuple[int, list]:
        found = self._by_free[free].pop()
        if not self._by_free[free]:
            self._bits &= ~(1 << free)
        self._open -= 1
        return found


def _batches(rows: Iterator[tuple], schema: pa.Schema, extra: tuple = ()) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row + extra)
        if len(held) == _ROWS_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def packed(
    documents: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    bins: int = 128,
    tokens_per_task: int = 16_000_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents with their ids and their place in a sequence.

    A document is its token ids and ``end_id``; only those longer than ``capacity`` are cut. A
    missing or empty text is the end id alone; a missing id stays missing; repeated rows are
    documents of their own; further columns are left out; an empty table gives no rows.

    ``ids`` holds little-endian unsigned 32-bit ids.
    """
    end = int(end_id).to_bytes(_ID_BYTES, "little")
    width = capacity * _ID_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary, "drops")
        open_bins = OpenBins(capacity, bins, TaskContext.get().partitionId() << 32)

        def closed() -> Iterator[tuple]:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1)
                for key, text in zip(keys, texts):
                    ids = tokenizer.encode([text.as_py()])[0] + end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        length = len(part) // _ID_BYTES
                        yield from open_bins.place((key, piece, at // _ID_BYTES, length, part), length)

        schema = _ARROW.append(pa.field("closed", pa.bool_()))
        yield from _batches(closed(), schema, (True,))
        yield from _batches(open_bins.drain(), schema, (False,))

    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bins = OpenBins(capacity, bins, (1 << 62) + (TaskContext.get().partitionId() << 32))

        def closed() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(column.to_pylist() for column in batch.columns)):
                    yield from open_bins.place(row, row[3])
            yield from open_bins.drain()

        yield from _batches(closed(), _ARROW)

    texts = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    first = stored(texts.mapInArrow(pack, f"{PACKED}, closed BOOLEAN"), "packed", "closed")
    left = first.where(~F.col("closed")).select("doc_id", "piece", "start", "length", "ids")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    again = (
        left.repartition(1 + int(tokens) // tokens_per_task, F.xxhash64("doc_id", "piece", "ids"))
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids")
        .mapInArrow(repack, PACKED)
    )
    return first.where("closed").drop("closed").unionByName(again)
