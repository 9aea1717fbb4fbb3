"""Alignment of two tokenizations of every text, and corpus-wide counts of the linked ids.

A text is encoded twice: ``" " + text`` by a byte-level BPE (A) and ``text`` by a sentencepiece
model (B, which adds the space itself). Each token stands for bytes: A's entry decoded from its
byte-level letters, B's piece in UTF-8 with U+2581 as a space and ``<0xHH>`` as byte HH. Where the
bytes of neither side join to ``" " + text`` (normalising, unknown pieces) the text has no tokens.

The method, per text: cumulative byte ends of both id lists go into end-to-index dictionaries
(arrays with a place for each byte, as the keys are dense); the intersection of their keys, in
order, holds the offsets where both sides end a token. These common ends slice both id lists into groups, and every A token of a group is linked with every B
token of it. Links are kept per text as distinct (A id, B id) pairs with their multiplicity, so a
long group of repeated ids costs its distinct pairs, not the product of its lengths.

In Spark: one Python pass per batch of texts (Arrow batches in and out, stored once), the links
exploded from it, one aggregate for the count of each id pair (documents that hold it), one for
each A id's highest count, and a sort-merge join of the links with those counts (never a
broadcast: the pairs grow with the corpus), which AQE may split where one pair is in most
documents because a shuffle stands directly below both sides. Per text, sums go back by a row key, so
repeated and missing ids are separate documents.

Odd rows: a null or empty text, or one whose bytes do not join, has zeros and ``groups_sha256``
``''``; a missing id gives a row with a missing ``doc_id``; repeated rows are documents each (a
pair in both counts twice). Very long texts are aligned whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored
from msgpulse.llm.tokens import _byte_letters

#: Ids of both vocabularies fit in 16 bits; a pair is coded as ``a << 16 | b``.
SHIFT = 16
_MISSING = b"\xff"  # never part of UTF-8: a piece without bytes can never join


class Sides:
    """Both tokenizers of a worker and the bytes of every id.

    A's ids come from its tokenizers file; given ``a_ranks``, the same vocabulary as tiktoken
    ranks encodes instead (the same ids, about three times faster on one core; the tests hold
    it against the tokenizers file). Special-token strings are ordinary text either way.
    """

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        if a_ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(a_ranks, "rb") as lines:
                ranks = {base64.b64decode(key): int(rank) for key, rank in map(bytes.split, lines)}
            ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: ranked.encode_ordinary_batch(texts, num_threads=1)
        else:
            self.encode = lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        back = {letter: byte for byte, letter in _byte_letters().items()}
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else _MISSING
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_unknown(i) or self.b.is_control(i):
                self.b_bytes.append(_MISSING)
            else:
                self.b_bytes.append(piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        assert len(self.a_bytes) <= 1 << SHIFT and len(self.b_bytes) <= 1 << SHIFT


_sides: dict[tuple, Sides] = {}


def sides(a_path: str, b_path: str, a_ranks: str | None = None) -> Sides:
    key = (a_path, b_path, a_ranks)
    if key not in _sides:
        _sides[key] = Sides(a_path, b_path, a_ranks)
    return _sides[key]


def _distinct(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) of one side, sorted by group, with their counts."""
    keys, counts = np.unique((groups << SHIFT) | ids, return_counts=True)
    return keys >> SHIFT, keys & ((1 << SHIFT) - 1), counts


#: Decimal text of every id, and the separators of the written groups.
_TEXT = np.array([str(i) for i in range(1 << SHIFT)], dtype=object)
_SEPS = np.array([",", "|", ";"], dtype=object)


def _by_end(ends: np.ndarray, size: int) -> np.ndarray:
    """The end-to-index dictionary of one side: the token that ends at each byte, the last of several; -1 for none."""
    found = np.full(size, -1, dtype=np.int32)
    found[ends] = np.arange(len(ends), dtype=np.int32)
    return found


def align(a_ids: list[int], b_ids: list[int], a_len: np.ndarray, b_len: np.ndarray) -> dict:
    """Groups and distinct links of two id lists over the same bytes."""
    a, b = np.asarray(a_ids, dtype=np.int64), np.asarray(b_ids, dtype=np.int64)
    ends_a, ends_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    size = 1 + max(ends_a[-1:].max(initial=0), ends_b[-1:].max(initial=0))
    at_a, at_b = _by_end(ends_a, size), _by_end(ends_b, size)
    common = np.flatnonzero((at_a >= 0) & (at_b >= 0))
    g = len(common)
    # The dictionaries give the last token of each group on both sides; the groups are the slices between.
    last_a, last_b = at_a[common].astype(np.int64), at_b[common].astype(np.int64)
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    ga, gb = np.repeat(np.arange(g), size_a), np.repeat(np.arange(g), size_b)
    n_links = int((size_a * size_b).sum())
    # Every distinct A id of a group meets every distinct B id of it.
    group_a, id_a, count_a = _distinct(ga, a)
    group_b, id_b, count_b = _distinct(gb, b)
    per_group = np.bincount(group_b, minlength=g)
    first_b = np.cumsum(per_group) - per_group
    reps = per_group[group_a]
    total = int(reps.sum())
    within = np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps)
    at = np.repeat(first_b[group_a], reps) + within
    codes = (np.repeat(id_a, reps) << SHIFT) | id_b[at]
    pairs, where = np.unique(codes, return_inverse=True)
    many = np.bincount(where, weights=np.repeat(count_a, reps) * count_b[at], minlength=len(pairs))
    # groups_sha256: ids of each group, A before B, groups in order.
    side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    group = np.concatenate([ga, gb])
    order = np.lexsort((side, group))
    side, group = side[order], group[order]
    last_of_side = np.append((side[1:] != side[:-1]) | (group[1:] != group[:-1]), True)
    parts = np.empty(2 * len(order), dtype=object)
    parts[0::2] = _TEXT[np.concatenate([a, b])[order]]
    parts[1::2] = _SEPS[np.where(last_of_side, 1 + side, 0)]
    written = "".join(parts.tolist())[:-1]
    return {
        "n_a": len(a),
        "n_b": len(b),
        "n_groups": g,
        "n_links": n_links,
        "groups_sha256": hashlib.sha256(written.encode()).hexdigest() if g else "",
        "pair_a": (pairs >> SHIFT).astype(np.int32),
        "pair_b": (pairs & ((1 << SHIFT) - 1)).astype(np.int32),
        "pair_n": np.rint(many).astype(np.int64),
    }


ALIGNED = (
    "_row BIGINT, doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, groups_sha256 STRING, "
    "pair_a ARRAY<INT>, pair_b ARRAY<INT>, pair_n ARRAY<BIGINT>"
)
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows holding at most ``most`` characters (a longer row alone)."""
    lo, held = 0, 0
    for k, n in enumerate(lengths):
        if k > lo and held + n > most:
            yield lo, k
            lo, held = k, 0
        held += n
    if lo < len(lengths):
        yield lo, len(lengths)


def _listed(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _aligner(a_path: str, b_path: str, slice_bytes: int, a_ranks: str | None = None):
    """The function of one Python pass over Arrow batches of ``_row, doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(a_path, b_path, a_ranks)
        empty = np.zeros(0, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # Slices of at most ``slice_bytes`` of text: the tokenizers hold one slice at a time.
            for lo, hi in _slices([len(t) if t else 0 for t in texts], slice_bytes):
                part = texts[lo:hi]
                live = [k for k, t in enumerate(part) if t]
                a_all = both.encode([" " + part[k] for k in live]) if live else []
                b_all = both.b.encode([part[k] for k in live]) if live else []
                found: list[dict | None] = [None] * len(part)
                for k, a_ids, b_ids in zip(live, a_all, b_all):
                    target = (" " + part[k]).encode()
                    if (
                        b"".join(map(both.a_bytes.__getitem__, a_ids)) == target
                        and b"".join(map(both.b_bytes.__getitem__, b_ids)) == target
                    ):
                        found[k] = align(a_ids, b_ids, both.a_len, both.b_len)
                del a_all, b_all
                columns = {
                    "_row": batch.column("_row").slice(lo, hi - lo),
                    "doc_id": batch.column("doc_id").slice(lo, hi - lo),
                }
                for name in _COUNTS:
                    columns[name] = pa.array([f[name] if f else 0 for f in found], pa.int64())
                columns["groups_sha256"] = pa.array([f["groups_sha256"] if f else "" for f in found], pa.string())
                for name, kind in (("pair_a", np.int32), ("pair_b", np.int32), ("pair_n", np.int64)):
                    columns[name] = _listed([f[name] if f else empty for f in found], kind)
                yield pa.RecordBatch.from_pydict(columns)

    return run


def aligned_texts(
    docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = 1 << 20, a_ranks: str | None = None
) -> DataFrame:
    """One row per document with its groups and distinct links, from one Python pass."""
    run = _aligner(a_path, b_path, slice_bytes, a_ranks)
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("bigint"), "text")
    return keyed.mapInArrow(run, ALIGNED)


def aligned(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose pair's count is the highest of any pair of its A id (ties
    included); ``count_sum`` sums the pair counts over the links; both count every occurrence pair.
    """
    texts = stored(aligned_texts(docs, a_path, b_path, a_ranks=a_ranks), "align-texts")
    # Exploded where used, from the stored texts: cheaper than writing the links once more.
    links = texts.select("_row", F.explode(F.arrays_zip("pair_a", "pair_b", "pair_n")).alias("p")).select(
        "_row", F.col("p.pair_a").alias("a"), F.col("p.pair_b").alias("b"), F.col("p.pair_n").alias("m")
    )
    counts = links.groupBy("a", "b").agg(F.count("*").alias("documents"))
    best = counts.groupBy("a").agg(F.max("documents").alias("top"))
    pairs = stored(
        counts.join(best, "a").select("a", "b", "documents", (F.col("documents") == F.col("top")).alias("best")),
        "align-pairs",
    )
    # The pairs grow with the corpus and have no size bound: a shuffle join at every size.
    per_text = (
        links.join(pairs.hint("merge"), ["a", "b"])
        .groupBy("_row")
        .agg(
            F.sum(F.col("m") * F.col("documents")).alias("count_sum"),
            F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"),
        )
    )
    return texts.join(per_text, "_row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"),
        "groups_sha256",
    )
