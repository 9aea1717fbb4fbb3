"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words and writes classes: insult, threat, target, negation, report,
end of clause, other. Four context transducers are composed behind it: an insult or threat near
a target counts for more, in the scope of a negation or of reported speech for less, and a threat
without a target for little. A clause scores the sum over its marked words of lexical weight
times context weight; a text is judged by what its clauses score.

Insults are word beginnings and whole words with weights, learned as log odds of toxic against
other labelled documents, besides a short fixed list. The labels used are a bounded sample of
the training rows; learning counts on Spark, and only the lexicon (bounded), the sample's clause
scores (bounded) and four numbers come to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from msgpulse.llm.scratch import stored
from msgpulse.llm.shingles import shingle_set
from msgpulse.llm.transducers import within

# The closed word classes and a short list of insults and threats.
TARGETS = frozenset(
    "you your yourself he him she her they them this that u du dich dir er sie ihr dieser tu toi vous il elle ce cet tú te usted él ella ese este".split()
)
NEGATIONS = frozenset("not no never isn't aren't don't doesn't wasn't nicht kein keine nie ne pas jamais nunca ni".split())
REPORTS = frozenset(
    "said says say wrote writes called calls quoted quote claimed claims sagte schrieb nannte dit disait écrit dijo llamó escribió".split()
)
INSULTS = frozenset("idiot moron scum loser stupid pathetic worthless disgusting trash clown imbecile dumbass".split())
THREATS = frozenset("kill murder stab strangle destroy hurt beat shoot töten umbringen tuer frapper matar golpear".split())

_KINDS = ("other", "insult", "threat", "target", "negation", "report", "end")
_STRIP = "\"'()[]{}<>*_.,;:!?…„“”«»¡¿-"
_ENDS = ".!?;"
_PREFIXES = (4, 5, 6)
_MARKED = frozenset({"insult", "threat"})

#: aimed, negated and reported are marks that contexts set; a threat that is not aimed keeps a tenth.
_CONTEXT = (
    within("target", 6, "aimed", 1.5, _MARKED)
    .then(within("negation", 3, "negated", 0.4, _MARKED))
    .then(within("report", 8, "reported", 0.5, _MARKED))
)
_TABLE = _CONTEXT.table([(kind, frozenset()) for kind in _KINDS])
_NUMBER = {kind: _TABLE.number[(kind, frozenset())] for kind in _KINDS}


def _parts(word: str) -> list[str]:
    """The lexicon's arcs that could accept a word: its beginnings and, with an end mark, all of it."""
    return [word[:n] for n in _PREFIXES if len(word) > n] + [word + "$"]


class _Classes(dict):
    """Raw word to (kind, weight, closes a clause), by the lexicon transducer."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self._learned = learned

    def __missing__(self, raw: str) -> tuple[int, float, bool]:
        word = raw.strip(_STRIP).lower()
        weight = max((self._learned.get(part, 0.0) for part in _parts(word)), default=0.0) if word else 0.0
        if word in INSULTS:
            weight = max(weight, 3.0)
        kind = (
            "insult"
            if weight > 0
            else "threat"
            if word in THREATS
            else "target"
            if word in TARGETS
            else "negation"
            if word in NEGATIONS
            else "report"
            if word in REPORTS
            else "other"
        )
        found = (_NUMBER[kind], weight or 3.0 * (kind == "threat"), raw[-1:] in _ENDS)
        if len(self) > 200_000:
            self.clear()
        self[raw] = found
        return found


def clause_scores(text: str, classes: _Classes) -> list[float]:
    """Scores of the clauses that have any; line ends and ``. ! ? ;`` close a clause."""
    scores, marked = [], (_NUMBER["insult"], _NUMBER["threat"])
    for line in text.split("\n"):
        found = list(map(classes.__getitem__, line.split()))
        if not any(kind in marked for kind, _, _ in found):
            continue
        state, total = 0, 0.0
        for kind, weight, closes in found:
            state, (_, marks), factor = _TABLE.arcs[state][kind]
            if kind in marked:
                total += weight * math.exp(factor) * (0.1 if kind == marked[1] and "aimed" not in marks else 1.0)
            if closes:
                state = _TABLE.arcs[state][_NUMBER["end"]][0]
                scores += [total] if total else []
                total = 0.0
        scores += [total] if total else []
    return scores


def features(text: str | None, classes: _Classes) -> tuple[float, float]:
    """The strongest clause, and the log of what all clauses score."""
    scores = clause_scores(text or "", classes)
    return (max(scores), math.log1p(sum(scores))) if scores else (0.0, 0.0)


def training_rows(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled training ids of each class, those with the smallest digests.

    An id is for training unless the CRC-32 of its digits leaves 1 when divided by 3.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    order = [F.md5(F.col("label_id").cast("string").cast("binary")), "label_id"]
    return known.where("toxic = 1").orderBy(*order).limit(limit).unionByName(known.where("toxic = 0").orderBy(*order).limit(limit))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit(rows: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights of (1, features) by Newton steps, lightly held to zero."""
    x = np.c_[np.ones(len(rows)), rows]
    weights = np.zeros(x.shape[1])
    hold = np.diag([1e-6, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (toxic - p) - hold @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def explaining(hits: list[list[int]], entries: int, fewest: int = 2, share: float = 0.02) -> list[int]:
    """Entries that explain the toxic texts: taken greedily while one covers ``fewest`` texts that
    no entry before it covers, besides all that are in a ``share`` of the texts."""
    where: list[set[int]] = [set() for _ in range(entries)]
    for text, found in enumerate(hits):
        for entry in found:
            where[entry].add(text)
    common = max(fewest, math.ceil(share * len(hits)))
    taken = [k for k in range(entries) if len(where[k]) >= common]
    open_texts = set(range(len(hits))).difference(*[where[k] for k in taken]) if taken else set(range(len(hits)))
    while True:
        best = max(range(entries), key=lambda k: (len(where[k] & open_texts), -k), default=None)
        if best is None or len(where[best] & open_texts) < fewest:
            return taken
        taken.append(best)
        open_texts -= where[best]


def learned(documents: DataFrame, labels: DataFrame, limit: int, entries: int, least: float) -> tuple[dict, np.ndarray]:
    """The insult arcs with their weights, and the logistic weights of the features."""
    sample = F.broadcast(training_rows(labels, limit))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), 5) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([int(s[k]) >> 1 if len(s) else None for s in sets], pa.int64()) for k in (0, -1)]],
                names=["text", "toxic", "least", "most"],
            )

    # Near copies share their least or greatest shingle; one of them stays, or else every
    # word of a toxic text with many copies would look like an insult.
    rows = stored(
        documents.join(sample, F.col("doc_id") == F.col("label_id"))
        .select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(ends, "text STRING, toxic INT, least BIGINT, most BIGINT")
        .dropDuplicates(["toxic", "least"])
        .dropDuplicates(["toxic", "most"])
        .select("text", "toxic"),
        "toxic-sample",
    )

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {raw.strip(_STRIP).lower() for raw in (text or "").split()}
                counts.update((part, toxic) for part in {part for word in words if word for part in _parts(word)})
            yield pa.RecordBatch.from_pydict(
                {"part": [k[0] for k in counts], "toxic": pa.array([k[1] for k in counts], pa.int32()), "n": list(counts.values())}
            )

    sizes = dict(rows.groupBy("toxic").count().collect())
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}, np.array([-6.0, 1.0, 0.0])
    odds = F.log((F.col("yes") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("no") + 0.5) / F.lit(other + 1.0))
    arcs = (
        rows.mapInArrow(parts, "part STRING, toxic INT, n BIGINT")
        .groupBy("part")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("no"))
        .where("yes >= 3")
        .withColumn("weight", odds)
        .where(F.col("weight") >= least)
        .orderBy(F.desc(F.col("weight") * F.col("yes")), "part")
        .limit(entries)
    )
    weights = {row["part"]: float(row["weight"]) for row in arcs.collect()}
    order = {part: k for k, part in enumerate(weights)}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                words = {raw.strip(_STRIP).lower() for raw in (text or "").split()}
                found.append(sorted({order[part] for word in words for part in _parts(word) if part in order}))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["hits"])

    covered = [row["hits"] for row in rows.where("toxic = 1").mapInArrow(hits, "hits ARRAY<INT>").collect()]
    parts_in_order = list(weights)
    lexicon = {parts_in_order[k]: weights[parts_in_order[k]] for k in explaining(covered, len(weights))}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(lexicon)
        for batch in batches:
            found = [features(text, classes) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), batch.column(1)],
                names=["strongest", "whole", "toxic"],
            )

    seen = rows.mapInArrow(measure, "strongest DOUBLE, whole DOUBLE, toxic INT").toPandas().to_numpy(float)
    return lexicon, _fit(seen[:, :2], seen[:, 2])


def scored(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    sample_limit: int = 10_000,
    entries: int = 5_000,
    least_odds: float = 3.0,
    keep: tuple[str, ...] = (),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, and the ``keep`` columns.

    Learning takes at most ``sample_limit`` labelled training rows of either class. A missing or
    empty text has no clause and the lowest score; a missing id is not held out; repeated rows score
    alike; without labels of both classes the fixed lists alone decide; an empty table gives no rows.
    """
    # The text goes into Python once: carried columns other than it ride in ``row``, and it comes back from its own column.
    carried = [name for name in keep if name not in (text_column, "doc_id")]
    kept = F.struct(*carried) if carried else F.lit(None).cast("struct<none:int>")
    texts = documents.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), kept.alias("row"))
    lexicon, weights = learned(texts.select("doc_id", "text"), labels, sample_limit, entries, least_odds)
    bias, strongest, whole = weights.tolist()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(lexicon)
        for batch in batches:
            values = [
                1 / (1 + math.exp(-max(-60.0, min(60.0, bias + strongest * a + whole * b))))
                for a, b in (features(text.as_py(), classes) for text in batch.column(1))
            ]
            out = [batch.column(0), batch.column(2), pa.array(values, pa.float64())] + ([batch.column(1)] if back else [])
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row", "score"] + (["text"] if back else []))

    back = text_column in keep
    schema = T.StructType(
        [texts.schema["doc_id"], texts.schema["row"], T.StructField("score", T.DoubleType())] + ([texts.schema["text"]] if back else [])
    )
    found = texts.mapInArrow(score, schema)
    return found.select(
        *[(F.col("text") if name == text_column else F.col("row")[name]).alias(name) for name in keep if name != "doc_id"],
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
