"""Substring deduplication by sliding spans of sentences.

From every sentence on, and up to every sentence, the span is the shortest run of sentences that has
at least two of them and ``min_words`` words, or one that alone has ``long_words``. Where a span ends depends
only on what it holds, so copies of a passage have the same spans wherever they stand; those that begin in it
and those that end in it together cover all of it. Every span is hashed, the hashes are counted over all documents, spans that occur again meet their hash's first
occurrence, and sentences inside any span but a first one are removed.

The first occurrence is that with the least (document id, sentence). Counting reduces inside each
task first, and the joins are on hashes that the engine splits when they are skewed, so a passage that
a third of all documents share is handled like any other. Texts move once, at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored

_END = re.compile(r"[.!?…][\"')\]”’»]*\s+|\s*\n\s*")


def sentences(text: str) -> list[str]:
    """The pieces of a text, each with the white space behind it; together they are the text."""
    if not text:
        return []
    cuts = [found.end() for found in _END.finditer(text)]
    bounds = [0, *cuts] if cuts and cuts[-1] == len(text) else [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def spans(pieces: list[str], min_words: int, long_words: int) -> list[tuple[int, int, int, int]]:
    """(first sentence, sentences, hash, further hash) of every span."""
    words = [piece.split() for piece in pieces]
    sizes = [len(w) for w in words]
    digests = [xxhash.xxh3_128_digest(" ".join(w).encode("utf-8", "surrogatepass")) for w in words]
    runs = set()
    for start in range(len(pieces)):
        total = 0
        for end in range(start + 1, len(pieces) + 1 if sizes[start] else 0):
            total += sizes[end - 1]
            if total >= (long_words if end == start + 1 else min_words):
                runs.add((start, end))
                break
    for last, size in enumerate(sizes):
        # A long sentence is a run alone, which begins there too.
        total = size
        for start in range(last - 1, -1 if 0 < size < long_words else last, -1):
            if not sizes[start]:
                break
            total += sizes[start]
            if total >= min_words:
                runs.add((start, last + 1))
                break
    found = []
    for start, end in sorted(runs):
        mark = xxhash.xxh3_128_intdigest(b"".join(digests[start:end]))
        found.append((start, end - start, (mark & (2**64 - 1)) - 2**63, mark >> 97))
    return found


def without_repeats(
    documents: DataFrame,
    min_words: int = 15,
    long_words: int = 25,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, n_sentences, n_removed, text`` of every row, the text without repeated spans.

    A missing text has no sentences and stays missing, an empty one stays empty; rows that share an id and a text
    count as one occurrence and lose the same sentences; missing ids come first and share one place in the
    order; further columns are left out; an empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                rows = [
                    (key, *span)
                    for key, text in zip(part.column(0).to_pylist(), part.column(1))
                    for span in spans(sentences(text.as_py() or ""), min_words, long_words)
                ]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["doc_id", "at", "n", "h", "g"]
                )

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts, gone, texts = [], [], []
                for text, repeats in zip(part.column(1).to_pylist(), part.column(2)):
                    pieces = sentences(text) if text else []
                    covered = np.zeros(len(pieces), bool)
                    if repeats.is_valid:
                        listed = {(r["at"], r["n"], r["h"], r["g"]) for r in repeats.as_py()}
                        for at, n, *_ in listed.intersection(spans(pieces, min_words, long_words)):
                            covered[at : at + n] = True
                    counts.append(len(pieces))
                    gone.append(int(covered.sum()))
                    texts.append("".join(p for p, c in zip(pieces, covered) if not c) if covered.any() else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_sentences", "n_removed", "text"],
                )

    texts = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    all_spans = stored(texts.mapInArrow(cut, "doc_id BIGINT, at INT, n INT, h BIGINT, g INT"), "spans")
    again = stored(all_spans.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 1").select("h", "g"), "repeated")
    repeated = stored(all_spans.join(again, ["h", "g"]), "occurrences")
    first = repeated.groupBy("h", "g").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    later = (
        repeated.join(first, ["h", "g"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_set(F.struct("at", "n", "h", "g")).alias("repeats"))
    )
    listed = stored(later, "repeats")
    return (
        texts.join(listed, F.col("doc_id").eqNullSafe(F.col("of")), "left")
        .select("doc_id", "text", "repeats")
        .mapInArrow(removed, "doc_id BIGINT, n_sentences BIGINT, n_removed BIGINT, text STRING")
    )
