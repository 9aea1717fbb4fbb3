"""N-gram Jaccard join: MinHash bands propose, full shingle sets decide.

Texts with the same shingle set are one text with a number of copies. Its signature is cut into
bands, whose count and height follow from the wanted recall, and rows meet in a shuffle on band
hashes. A bucket is a band hash with two texts or more; of buckets with the same members only
that of the lowest band stays. A bucket is dealt into blocks of bounded load, and one task
compares the full sets of two blocks, so that no group, however large, meets in one task, and
pairs are counted where they are found instead of being written out. A pair is compared in the
lowest band that its texts share, hence once.

Every block yields per text the copies it is linked to and the least text it is connected with;
the sums are the links, the connected components are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgpulse.llm.components import components
from msgpulse.llm.runs import groups
from msgpulse.llm.scratch import stored
from msgpulse.llm.shingles import Banding, banding_for, fingerprint, forget, shingle_set

#: Load of a text in a block besides its shingles, which bounds the texts of a block.
_ROW_LOAD = 200
_STRIP = 512


def _forgetting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; when they end, the worker's word hashes go."""
    try:
        yield from batches
    finally:
        forget()


def _intersections(sets: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Common shingles of the sets at ``rows`` with every set, by products of bit columns."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.r_[True, values[1:] != values[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((len(rows), len(sets)), np.float32)
    ends = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 4097, 4096))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        bits = np.zeros((len(sets), 4096), np.float32)
        bits[owner[a:b], column[a:b] - 4096 * k] = 1
        common += bits[rows] @ bits.T
    return common


def linked(
    sets: list[np.ndarray], bands: np.ndarray, band: int, side: np.ndarray | None, similarity: Fraction
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) at the similarity that first meet in this band.

    With a ``side`` (0 or 1) texts of different sides are compared, without one all among themselves.
    """
    n = np.array([len(s) for s in sets])
    over, under = similarity.numerator, similarity.denominator
    for start in range(0, len(sets), _STRIP):
        rows = np.arange(start, min(start + _STRIP, len(sets)))
        wanted = bands[rows, band][:, None] == bands[None, :, band]
        for k in range(band):
            wanted &= bands[rows, k][:, None] != bands[None, :, k]
        wanted &= np.arange(len(sets))[None, :] > rows[:, None]
        wanted &= under * np.minimum(n[rows][:, None], n[None, :]) >= over * np.maximum(n[rows][:, None], n[None, :])
        if side is not None:
            wanted &= side[rows][:, None] != side[None, :]
        i, j = np.nonzero(wanted)
        if not len(i):
            continue
        i += start
        if len(i) <= 64:
            common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)])
        else:
            used, at = np.unique(np.r_[i, j], return_inverse=True)
            left, at_left = np.unique(at[: len(i)], return_inverse=True)
            common = _intersections([sets[u] for u in used], left)[at_left, at[len(i) :]]
        good = under * common >= over * (n[i] + n[j] - common)
        yield i[good], j[good]


def _verified(similarity: Fraction, bands: int):
    schema = pa.schema([("tid", pa.binary()), ("root", pa.binary()), ("links", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            tids = group.column("tid").to_pylist()
            kept = np.array(sorted({tid: k for k, tid in reversed(list(enumerate(tids)))}.values()))
            tids = [tids[k] for k in kept]
            if len(tids) < 2:
                continue
            copies = group.column("copies").to_numpy()[kept]
            found, signatures = group.column("shingles"), group.column("bands")
            sets = [np.frombuffer(found[int(k)].as_py(), np.uint64) for k in kept]
            signature = np.stack([np.frombuffer(signatures[int(k)].as_py(), np.int64) for k in kept])
            side = None
            if group.column("across")[0].as_py():
                block = group.column("block").to_numpy()[kept]
                side = block != block[0]
                # The other block is empty; this one's texts meet in their own pair.
                if not side.any():
                    continue
            root = np.arange(len(tids))
            links = np.zeros(len(tids), np.int64)

            def top(k: int) -> int:
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            for i, j in linked(sets, signature, group.column("band")[0].as_py(), side, similarity):
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                for a, b in zip(i.tolist(), j.tolist()):
                    if root[a] != root[b]:
                        a, b = top(a), top(b)
                        root[max(a, b)] = min(a, b)
            hit = np.flatnonzero(links)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tids[k] for k in hit]), pa.array([tids[top(int(k))] for k in hit]), pa.array(links[hit])],
                    schema=schema,
                )

    return verify


def near_copies(
    documents: DataFrame,
    width: int = 5,
    similarity: float = 0.8,
    recall: float = 0.995,
    block_load: int = 300_000,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row.

    ``n_links`` counts the other rows whose shingles reach ``similarity``, exact copies among
    them; ``class_id`` is the least id of the rows connected by links. A text without words has no shingles and no
    links and is a class of its own; a shorter text than ``width`` words is one shingle. A
    missing id stays missing and never names a class that has another id; repeated rows are copies of
    each other; further columns are left out; an empty table gives no rows.
    """
    bands, rows = banding_for(similarity, recall)
    limit = Fraction(str(similarity))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _forgetting(_sign(batches))

    def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = Banding(bands, rows)
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([banding(s).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "tid", "n", "keys"],
            )

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _forgetting(_full(batches))

    def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = Banding(bands, rows)
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column(2).to_pylist()]
            own = [k for k, s in enumerate(sets) if fingerprint(s) == batch.column(0)[k].as_py()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(own, pa.int64())),
                    batch.column(1).take(pa.array(own, pa.int64())),
                    pa.array([banding(sets[k]).tobytes() for k in own], pa.binary()),
                    pa.array([sets[k].tobytes() for k in own], pa.binary()),
                ],
                names=["tid", "copies", "bands", "shingles"],
            )

    texts = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    signed = stored(texts.mapInArrow(sign, "doc_id BIGINT, tid BINARY, n INT, keys ARRAY<BIGINT>"), "signatures")
    distinct = stored(
        signed.where("tid IS NOT NULL")
        .groupBy("tid")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")),
        "texts",
    )
    banded = distinct.select("tid", "n", F.posexplode("keys").alias("band", "key"))
    buckets = (
        banded.groupBy("band", "key")
        .agg(
            F.count("*").alias("members"),
            F.sum(F.col("n") + _ROW_LOAD).alias("load"),
            F.bit_xor(F.xxhash64("tid")).alias("who"),
            F.bit_xor(F.xxhash64(F.lit(1), "tid")).alias("who_else"),
        )
        .where("members > 1")
        .groupBy("members", "who", "who_else")
        .agg(F.min(F.struct("band", "key", (1 + F.floor(F.col("load") / block_load)).cast("int").alias("blocks"))).alias("b"))
        .select("b.*")
    )
    members = stored(banded.join(stored(buckets, "buckets"), ["band", "key"]).select("band", "key", "blocks", "tid"), "members")
    active = members.select("tid").distinct().join(distinct.select("tid", "rep", "copies"), "tid")
    sets = stored(
        active.join(texts, F.col("rep").eqNullSafe(F.col("doc_id")))
        .select("tid", "copies", "text")
        .mapInArrow(full, "tid BINARY, copies BIGINT, bands BINARY, shingles BINARY"),
        "shingles",
    )
    block = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    spread = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    compared = (
        spread.withColumn("pair", pair)
        .select("key", "band", "pair", "block", (F.col("block") != F.col("other")).alias("across"), "tid")
        .join(sets, "tid")
        .select("key", "band", "pair", "block", "across", "tid", "copies", "bands", "shingles")
        .repartition("key", "band", "pair")
        .sortWithinPartitions("key", "band", "pair")
        .mapInArrow(_verified(limit, bands), "tid BINARY, root BINARY, links BIGINT")
    )
    found = stored(compared, "links")
    roots = components(found.select(F.col("tid").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    placed = (
        distinct.select("tid", "rep", "copies")
        .join(links, "tid", "left")
        .join(roots.withColumnRenamed("node", "tid"), "tid", "left")
        .withColumn("root", F.coalesce("root", "tid"))
    )
    named = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = placed.join(named, "root").select(
        "tid", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return signed.join(classes, "tid", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )
