"""Exact top-k inner products by MaxScore over shards.

A vector's components are its terms, a shard holds one posting list per term. For a query every
term has a bound, the most it can add over the least it can add in this shard. Terms are
ordered by bound; with the k-th best score so far as the mark, the trailing terms whose bounds together
cannot lift a candidate to the mark are non-essential. Essential postings are traversed for a block of candidates at
a time; the candidates still competitive are probed in the other terms, strongest first, and dropped as
soon as their score and the bounds left fall below the mark. Shards' lists are merged.

Queries and candidates meet block by block: neither side is broadcast, the blocks bound the memory
of a task, and the work of a pair of blocks is the same for every pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgpulse.llm.runs import groups
from msgpulse.llm.scratch import stored

_PROBES = 8
_EXACT = 2.0**53


class Shard:
    """Posting lists of a block of candidates, as columns of one matrix in order of the ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = 2048):
        order = np.argsort(ids, kind="stable")
        self.ids, self._postings = ids[order], np.ascontiguousarray(rows[order].T)
        self._most, self._least = self._postings.max(axis=1), self._postings.min(axis=1)
        self._block = block

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates but ``own``, ties to the smaller id."""
        adds, lacks = np.maximum(query * self._most, query * self._least), np.minimum(query * self._most, query * self._least)
        order = np.argsort(-(adds - lacks), kind="stable")
        query = query[order]
        #: The most that the terms from each place on can add.
        rest = np.r_[np.cumsum(adds[order][::-1])[::-1], 0]
        floor = np.r_[0, np.cumsum(lacks[order])]
        ids, scores = np.empty(0, np.int64), np.empty(0)
        mark = -np.inf
        for start in range(0, len(self.ids), self._block):
            at = np.arange(start, min(start + self._block, len(self.ids)))
            # A candidate that has the least of all essential terms cannot reach the mark by the others.
            hopeless = floor + rest < mark
            essential = int(hopeless.argmax()) if hopeless.any() else len(query)
            postings = self._postings[:, start : start + len(at)]
            here = np.arange(len(at))
            partial = query[:essential] @ postings[order[:essential]]
            while True:
                live = partial + rest[essential] >= mark
                if not live.all():
                    here, partial = here[live], partial[live]
                if essential == len(query) or not len(here):
                    break
                more = order[essential : essential + _PROBES]
                seen = postings[more] if len(here) == len(at) else postings[np.ix_(more, here)]
                partial = partial + query[essential : essential + _PROBES] @ seen
                essential += len(more)
            at = at[here]
            keep = self.ids[at] != own
            ids, scores = np.r_[ids, self.ids[at][keep]], np.r_[scores, partial[keep]]
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
            mark = scores[-1] if len(scores) == k else -np.inf
        return ids, scores


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    scale: int = 64,
    shard_rows: int = 10_000,
    query_rows: int = 5_000,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the k best others.

    Components are floor(scale * x). Rows with a missing id, and vectors that are missing or hold a
    missing or non-finite component, take no part; an empty vector scores 0 against all, and of vectors of different length the
    shorter is filled with zeros. An id names one row: of rows that share one, that with the least components in order
    counts. Further columns are left out; an empty table gives no rows. Scores are exact as long
    as they stay below 2**53.
    """
    whole = F.transform(vector_column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.forall(vector_column, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = stored(
        vectors.where(F.col(id_column).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col(id_column).cast("bigint").alias("vec_id"), whole.alias("terms"))
        .groupBy("vec_id")
        .agg(F.min("terms").alias("terms")),
        "vectors",
    )
    asks = F.col("vec_id") % every == 0
    n_rows, n_queries = rows.agg(F.count("*"), F.coalesce(F.count_if(asks), F.lit(0))).first()
    shards, blocks = 1 + n_rows // shard_rows, 1 + n_queries // query_rows
    place = F.xxhash64("vec_id")
    sides = [
        rows.where(asks).select(
            F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(place, F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "terms"
        ),
        rows.select(
            F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), "vec_id", "terms"
        ),
    ]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            ids, side = group.column("vec_id").to_numpy(), group.column("side").to_numpy()
            terms = group.column("terms").combine_chunks()
            sizes = np.diff(terms.offsets.to_numpy())
            values = np.zeros((len(ids), max(1, sizes.max())))
            values[np.arange(values.shape[1])[None, :] < sizes[:, None]] = terms.flatten().to_numpy()
            if not (side == 0).any() or not (side == 1).any():
                continue
            if np.abs(values).max() ** 2 * values.shape[1] >= _EXACT:
                raise ArithmeticError("components are too large for exact scores")
            shard = Shard(ids[side == 1], values[side == 1])
            found = [(own, *shard.best(query, own, k)) for own, query in zip(ids[side == 0], values[side == 0])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([own for own, _, _ in found], [len(best) for _, best, _ in found]), pa.int64()),
                    pa.array(np.concatenate([best for _, best, _ in found]), pa.int64()),
                    pa.array(np.concatenate([scores for _, _, scores in found]).astype(np.int64), pa.int64()),
                ],
                schema=schema,
            )

    lists = (
        sides[0].unionByName(sides[1])
        .repartition(shards * blocks, "shard", "block")
        .sortWithinPartitions("shard", "block")
        .mapInArrow(search, "query_id BIGINT, vec_id BIGINT, score BIGINT")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
