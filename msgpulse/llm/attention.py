"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages: its lines, each cut into runs of at most ``PASSAGE_WORDS`` words
(a text without any word is one empty passage). Every passage is encoded by fixed features
(shape figures and hashed words) followed by a learned layer ``h = tanh(We x + be)``. Gated
attention (Ilse et al., 2018) weighs the passages of a bag,
``a_k = softmax_k(w' (tanh(V h_k) * sigmoid(U h_k)))``, and the document's score is
``sigmoid(c' sum_k a_k h_k + c0)``. Only document labels are known; the attention learns which
passages decide.

Spark: passage features of the training documents are made on the executors; the model is fit on
the driver by full-batch gradient descent over at most ``max_train`` labelled documents (a
documented bound; a deterministic hash sample beyond it), and every document of the table is
scored in ``mapInPandas`` with the weights shipped in the closure (a few thousand numbers).

Odd rows: a null or empty text is one empty passage and gets the score of that; very long texts
are read whole; repeated rows are documents each (repeated labelled rows are bags each); a missing
id is never a training row (no label can meet it) and is scored like any other. Labels, language,
source and id are never features. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 64
BUCKETS = 32
HIDDEN, GATE = 16, 8
_CLASSES = {
    "alpha": re.compile(r"[^\W\d_]"),
    "digit": re.compile(r"\d"),
    "upper": re.compile(r"[A-ZÀ-Þ]"),
    "punct": re.compile(r"[.,;:!?]"),
    "symbol": re.compile(r"[#*$%&|<>{}\[\]=_/\\@~^`]"),
    "wide": re.compile(r"[^\x00-\x7f]"),
}
SHAPES = 16
FEATURES = SHAPES + BUCKETS


def passages(text: str | None) -> list[tuple[str, bool, float]]:
    """(passage, line seen before in the text, place in the text from 0 to 1) of a text."""
    lines = (text or "").split("\n")
    seen: set[str] = set()
    found = []
    for place, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        stripped = line.strip()
        repeated = stripped in seen
        seen.add(stripped)
        for start in range(0, len(words), PASSAGE_WORDS):
            found.append((" ".join(words[start : start + PASSAGE_WORDS]), repeated, place / max(1, len(lines) - 1)))
    return found or [("", False, 0.0)]


def features(text: str | None) -> np.ndarray:
    """One row of ``FEATURES`` figures per passage of a text."""
    parts = passages(text)
    out = np.zeros((len(parts), FEATURES), dtype=np.float32)
    for k, (passage, repeated, place) in enumerate(parts):
        words = passage.split()
        n, chars = len(words), max(1, len(passage))
        if n:
            counts = {name: len(pattern.findall(passage)) for name, pattern in _CLASSES.items()}
            lengths = [len(w) for w in words]
            out[k, :SHAPES] = (
                np.log1p(n),
                sum(lengths) / n / 10,
                counts["alpha"] / chars,
                counts["digit"] / chars,
                counts["upper"] / chars,
                counts["punct"] / chars,
                counts["symbol"] / chars,
                counts["wide"] / chars,
                len(set(words)) / n,
                sum(w[-1] in ".!?" for w in words) / n,
                float(repeated),
                sum(x >= 12 for x in lengths) / n,
                float(passage[-1] in ".!?"),
                sum(w[0].isupper() for w in words) / n,
                place,
                np.log1p(len(passage)) / 5,
            )
            for word in words:
                out[k, SHAPES + zlib.crc32(word.lower().encode()) % BUCKETS] += 1.0 / n
    return out


def _bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    rows = [features(t) for t in texts]
    return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])


def _sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Model:
    """Weights of the encoder, the gated attention and the head, with their gradient."""

    NAMES = ("We", "be", "V", "U", "w", "c", "c0")

    def __init__(self, seed: int = 0, mean=None, scale=None):
        rng = np.random.default_rng(seed)
        self.p = {
            "We": rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)),
            "be": np.zeros(HIDDEN),
            "V": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "U": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, GATE)),
            "w": rng.normal(0, 1 / np.sqrt(GATE), GATE),
            "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            "c0": np.zeros(1),
        }
        self.mean = np.zeros(FEATURES) if mean is None else mean
        self.scale = np.ones(FEATURES) if scale is None else scale

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> tuple[np.ndarray, dict]:
        p = self.p
        xn = (x - self.mean) / self.scale
        h = np.tanh(xn @ p["We"] + p["be"])
        a1, a2 = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        g = a1 * a2
        s = g @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, s)
        e = np.exp(s - top[bag])
        a = e / np.bincount(bag, weights=e, minlength=bags)[bag]
        z = np.zeros((bags, HIDDEN))
        np.add.at(z, bag, a[:, None] * h)
        prob = _sigmoid(z @ p["c"] + p["c0"][0])
        return prob, {"xn": xn, "h": h, "a1": a1, "a2": a2, "g": g, "a": a, "z": z}

    def gradient(self, x, bag, y, weight, l2=1e-4):
        """Weighted log loss and its gradient over all bags."""
        bags = len(y)
        prob, k = self.forward(x, bag, bags)
        p = self.p
        eps = 1e-12
        loss = -(weight * (y * np.log(prob + eps) + (1 - y) * np.log(1 - prob + eps))).sum() / weight.sum()
        loss += l2 * sum((p[n] ** 2).sum() for n in ("We", "V", "U", "w", "c"))
        dlogit = weight * (prob - y) / weight.sum()
        grad = {"c": k["z"].T @ dlogit, "c0": np.array([dlogit.sum()])}
        dz = dlogit[:, None] * p["c"][None, :]
        h, a = k["h"], k["a"]
        da = (dz[bag] * h).sum(axis=1)
        dh = a[:, None] * dz[bag]
        ds = a * (da - np.bincount(bag, weights=a * da, minlength=bags)[bag])
        grad["w"] = k["g"].T @ ds
        dg = ds[:, None] * p["w"][None, :]
        dv = dg * k["a2"] * (1 - k["a1"] ** 2)
        du = dg * k["a1"] * k["a2"] * (1 - k["a2"])
        grad["V"], grad["U"] = h.T @ dv, h.T @ du
        dh += dv @ p["V"].T + du @ p["U"].T
        dpre = dh * (1 - h**2)
        grad["We"], grad["be"] = k["xn"].T @ dpre, dpre.sum(axis=0)
        for n in ("We", "V", "U", "w", "c"):
            grad[n] = grad[n] + 2 * l2 * p[n]
        return loss, grad

    def fit(self, x, bag, y, steps: int = 400, rate: float = 0.02) -> list[float]:
        """Adam over all bags at once; both classes weigh alike."""
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + 1e-6
        positive = max(1.0, y.sum())
        negative = max(1.0, len(y) - y.sum())
        weight = np.where(y > 0, len(y) / (2 * positive), len(y) / (2 * negative))
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        losses = []
        for t in range(1, steps + 1):
            loss, grad = self.gradient(x, bag, y, weight)
            losses.append(loss)
            for n in self.p:
                m[n] = 0.9 * m[n] + 0.1 * grad[n]
                v2[n] = 0.999 * v2[n] + 0.001 * grad[n] ** 2
                self.p[n] -= rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v2[n] / (1 - 0.999**t)) + 1e-8)
        return losses

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each text and the attention of its heaviest passage."""
        x, bag = _bags(texts)
        prob, k = self.forward(x, bag, len(texts))
        heaviest = np.zeros(len(texts))
        np.maximum.at(heaviest, bag, k["a"])
        return prob, heaviest


def held_out(doc_id, fold: int = 4, rest: int = 2):
    """Rows the model never learns from: ``crc32(doc_id as text) % fold == rest``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % fold == rest, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 4000, seed: int = 0) -> Model:
    """A model fit on at most ``max_train`` labelled documents outside the held-out fold."""
    # The training ids first, from the labels alone: at most ``max_train`` rows, so the documents
    # are filtered by a broadcast of a bounded table and no text is shuffled.
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).alias("_label"))
        .orderBy(F.xxhash64("doc_id", "_label"), "doc_id", "_label")
        .limit(max_train)
    )
    # Repeated documents under one id are bags each; the same bound holds for them.
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(F.broadcast(known), "doc_id")
        .orderBy(F.xxhash64("doc_id", "_label"), "doc_id", F.xxhash64("text"))
        .limit(max_train)
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [features(text).ravel().tolist() for text in batch["text"]]
            yield pd.DataFrame({"x": x, "y": batch["_label"].astype(int).to_numpy()})

    found = rows.select("text", "_label").mapInPandas(encode, "x ARRAY<FLOAT>, y INT").collect()
    model = Model(seed)
    if not found:
        return model
    parts = [np.asarray(r["x"], dtype=np.float64).reshape(-1, FEATURES) for r in found]
    y = np.array([r["y"] for r in found], dtype=np.float64)
    model.fit(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), (y > 0).astype(float))
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, max_train: int = 4000) -> DataFrame:
    """``doc_id, held_out, score, predicted, attention`` of every document."""
    model = trained(docs, labels, label, max_train)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prob, heaviest = model.score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), "score": prob, "attention": heaviest})

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(
        run, "doc_id BIGINT, score DOUBLE, attention DOUBLE"
    )
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "attention",
    )
