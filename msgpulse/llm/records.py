"""Token ids as length-delimited binary records in shared files, with an offset index.

A record is framed as

    length   8 bytes, of the payload
    check    4 bytes, masked CRC-32 of the length bytes
    payload  1 byte: bit 0 the document has an id, bit 1 ids take 4 bytes instead of 2
             8 bytes: the document's id
             the token ids
    check    4 bytes, masked CRC-32 of the payload
    end      one line feed

all little-endian; masked means rotated right by 15 bits plus a constant, so that a checksum stored
among data is not mistaken for a checksum of it. Files follow one another in ascending order of the document
ids and are written by Spark's own committers, so a lost executor leaves no half file; the line feed is what
Spark's writer puts behind every value. The index has a row per record (file, place, offset, length, tokens),
taken from the written files, and lets a reader fetch records in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored
from msgpulse.llm.tokens import encoder

_LENGTH, _CHECK, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
_HAS_ID, _WIDE = 1, 2
# Fixed value: the constant of the mask.
_MASK = 0xA282EAD8
_BATCH = 4 << 20

INDEX = "file STRING, place BIGINT, doc_id BIGINT, offset BIGINT, length BIGINT, n_tokens BIGINT"
RECORDS = "file STRING, doc_id BIGINT, start_in_file BIGINT, n_tokens BIGINT, ids BINARY"


class Damaged(ValueError):
    """A record whose checksums do not fit, or a file that ends inside one."""


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record without its line feed; ``ids`` are little-endian ``uint32``."""
    values = np.frombuffer(ids, "<u4")
    wide = bool(len(values)) and int(values.max()) > 0xFFFF
    flags = _HAS_ID * (doc_id is not None) | _WIDE * wide
    payload = _HEAD.pack(flags, doc_id or 0) + values.astype("<u4" if wide else "<u2").tobytes()
    length = _LENGTH.pack(len(payload))
    return length + _CHECK.pack(masked(zlib.crc32(length))) + payload + _CHECK.pack(masked(zlib.crc32(payload)))


def frames(content) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length with the line feed, payload view) of every record, both checksums verified."""
    at, view = 0, memoryview(content)
    while at < len(view):
        begin = at + _LENGTH.size + _CHECK.size
        head = view[at : at + _LENGTH.size]
        if begin > len(view) or masked(zlib.crc32(head)) != _CHECK.unpack_from(view, at + _LENGTH.size)[0]:
            raise Damaged(f"length at {at}")
        end = begin + _LENGTH.unpack(head)[0]
        if end + _CHECK.size + 1 > len(view) or masked(zlib.crc32(view[begin:end])) != _CHECK.unpack_from(view, end)[0]:
            raise Damaged(f"record at {at}")
        yield at, end + _CHECK.size + 1 - at, view[begin:end]
        at = end + _CHECK.size + 1


def hops(content) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length with the line feed, payload view) of every record, from length to length.

    Each length is verified by its own checksum and each record must end in the file with its
    line feed; payloads are not read here (``read`` verifies them).
    """
    at, view = 0, memoryview(content)
    while at < len(view):
        begin = at + _LENGTH.size + _CHECK.size
        if begin > len(view) or masked(zlib.crc32(view[at : at + _LENGTH.size])) != _CHECK.unpack_from(view, at + _LENGTH.size)[0]:
            raise Damaged(f"length at {at}")
        end = begin + _LENGTH.unpack_from(view, at)[0]
        if end + _CHECK.size + 1 > len(view) or view[end + _CHECK.size] != 0x0A:
            raise Damaged(f"record at {at}")
        yield at, end + _CHECK.size + 1 - at, view[begin:end]
        at = end + _CHECK.size + 1


def opened(payload: bytes) -> tuple[int | None, bytes]:
    """The document's id and its token ids as little-endian ``uint32``."""
    flags, doc_id = _HEAD.unpack_from(payload)
    values = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_HEAD.size)
    return doc_id if flags & _HAS_ID else None, values.astype("<u4").tobytes()


def indexed(file: str, content: bytes) -> pa.RecordBatch:
    """Index rows of one file."""
    rows = []
    for place, (at, length, payload) in enumerate(hops(content)):
        flags, doc_id = _HEAD.unpack_from(payload)
        tokens = (len(payload) - _HEAD.size) // (4 if flags & _WIDE else 2)
        rows.append((file, place, doc_id if flags & _HAS_ID else None, at, length, tokens))
    kinds = (pa.string(), *[pa.int64()] * 5)
    names = ["file", "place", "doc_id", "offset", "length", "n_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)


def write(
    documents: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    file_bytes: int = 16 << 20,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode whole texts, each with ``end_id`` behind it, and write ``path/records`` and ``path/index``.

    Missing ids come first; rows with equal ids stand in order of a text digest, equal rows in
    any order; a missing or empty text is the end id alone; further columns are left out; an empty
    table gives files without records. A file holds about ``file_bytes`` of text.
    """
    spark = documents.sparkSession
    end = int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary, "leads")
        held, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(frame(key, tokenizer.encode([text.as_py()])[0] + end))
                size += len(held[-1])
                if size > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    texts = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = texts.withColumn("digest", F.xxhash64("text"))
    (
        ordered.repartitionByRange(1 + int(total) // file_bytes, "doc_id", "digest")
        .sortWithinPartitions("doc_id", "digest")
        .select("doc_id", "text")
        .mapInArrow(encode, "record BINARY")
        .select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\n").option("compression", "none").text(f"{path}/records")
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield indexed(file, content.as_buffer())

    _files(spark, path).mapInArrow(index, INDEX).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every record, its checksums verified; ``start`` counts the ids of all
    records before it and ``ids`` are little-endian ``uint32``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size, start = [], 0, 0
                for _, length, payload in frames(content.as_buffer()):
                    doc_id, ids = opened(payload)
                    held.append((file, doc_id, start, len(ids) // 4, ids))
                    start, size = start + len(ids) // 4, size + 2 * length
                    if size > _BATCH:
                        yield _records(held)
                        held, size = [], 0
                if held:
                    yield _records(held)

    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, stored so that its size is known and the records are not shuffled to meet it.
    files = stored(
        index_of(spark, path)
        .groupBy(F.col("file").alias("of"))
        .agg(F.sum("n_tokens").alias("tokens"))
        .select("of", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")),
        "bases",
    )
    return (
        _files(spark, path)
        .mapInArrow(parse, RECORDS)
        .join(files, F.col("file") == F.col("of"))
        .select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")
    )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["file", "doc_id", "start_in_file", "n_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the records of the ids in ``wanted``, found through the index; files without any are not opened
    by Python, and of the others only the records asked for are parsed."""
    found = index_of(spark, path).join(wanted.select(F.col("doc_id").cast("bigint")).distinct(), "doc_id", "left_semi")
    # A file bounds the records of its list.
    cuts = found.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1).to_pylist()):
                view = memoryview(content.as_buffer())
                rows = [opened(payload) for place in places for _, _, payload in frames(view[place["offset"] : place["offset"] + place["length"]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.int64()), pa.array([ids for _, ids in rows], pa.binary())], names=["doc_id", "ids"]
                )

    return _files(spark, path).join(cuts, "file").select("content", "cuts").mapInArrow(cut, "doc_id BIGINT, ids BINARY")
