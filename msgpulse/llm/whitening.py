"""Whitening of embeddings by an incremental eigendecomposition of their covariance.

The method, in four Spark steps over a stored table of integer vectors:

1. exact sums: ``n`` and the per-dimension sums ``S`` as long integers (one narrow aggregate, a
   few rows per dimension to the driver);
2. every partition folds its rows, centred on the global mean ``S / n``, into an eigendecomposition
   ``Q diag(d) Q'`` by rank-one updates: ``z = Q'v``, clusters of equal ``d`` are rotated so one
   entry of ``z`` carries them, entries of ``z`` near zero are deflated, and the new eigenvalues
   are the roots of the secular equation ``1 + sum z_i^2 / (d_i - l) = 0``; eigenvectors follow
   from the recomputed ``z`` (Loewner), which keeps them orthogonal;
3. partition spectra are combined in a tree of small groups, each by successive rank-one updates
   with ``sqrt(d_j) q_j`` of the spectra it merges;
4. Rayleigh-Ritz: the combined basis, made orthonormal, is refined by one distributed pass that
   sums ``(V Q)'(V Q)`` over partitions; the small matrix's eigenvectors rotate the basis. This
   gives the eigenvectors of the covariance to double precision whatever rounding the updates left.

What reaches the driver is bounded by the dimension ``d``: ``d`` sums, one ``d x d`` spectrum per
group of at most ``fan`` spectra, one ``d x d`` sum. Rows never do.

Odd rows: a null vector, one with a null or non-finite entry, and one whose length is not the
most common length take no part and give no row (the most common length is the one that a table
of embeddings has; ties go to the greater length). An empty fit list gives no rows. Ids are
carried, not used: null and repeated ids give rows like any other. A component with eigenvalue 0
(fewer independent rows than dimensions) has ``whitened`` 0 and is left out of
``identity_error``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgpulse.llm.scratch import stored

#: Fixed values of the contract: the scale, offset and number of components.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32

#: Bisection steps of the secular equation; the Rayleigh-Ritz pass refines what they leave.
STEPS = 48


def integer_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id`` and long ``x = floor(64 c) + 1000000`` of every usable row, stored once."""
    c = F.col("embedding")
    usable = embeddings.where(
        c.isNotNull() & (F.size(F.filter(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))) == 0)
    )
    x = F.transform(c, lambda v: (F.floor(SCALE * v.cast("double")) + OFFSET).cast("bigint"))
    vectors = stored(usable.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")), "whiten-x")
    lengths = vectors.groupBy(F.size("x").alias("d")).count().collect()  # one row per distinct length
    if not lengths:
        return vectors.limit(0), 0
    d = max(lengths, key=lambda r: (r["count"], r["d"]))["d"]
    return vectors.where(F.size("x") == d), d


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """``n`` and per-dimension sums as Python integers; ``d + 1`` rows reach the driver."""
    rows = (
        vectors.select(F.posexplode("x").alias("i", "v"))
        .groupBy("i")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
        .collect()
    )
    sums = [0] * d
    n = 0
    for row in rows:
        sums[row["i"]] = int(row["s"])
        n = int(row["n"])
    return n, sums


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` in double, with the integer part of the mean taken off exactly first."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - part


def rank_one(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of ``Q diag(d) Q' + v v'``."""
    z = q.T @ v
    scale = max(float(np.abs(d).max(initial=0.0)), float(v @ v), 1e-300)
    tol = 1e-13 * scale
    q = q.copy()
    # Rotate each cluster of equal eigenvalues so that one entry of z carries it.
    start = 0
    for end in [*(np.flatnonzero(np.diff(d) > tol) + 1).tolist(), len(d)]:
        if end - start > 1:
            part = z[start:end]
            norm = float(np.sqrt(part @ part))
            if norm > 0:
                u = part / norm
                u[0] -= 1.0
                un = float(u @ u)
                if un > 1e-30:
                    h = np.eye(end - start) - 2.0 * np.outer(u, u) / un
                    q[:, start:end] = q[:, start:end] @ h
                    z[start:end] = 0.0
                    z[start] = norm
        start = end
    live = np.flatnonzero(np.abs(z) > 1e-15 * np.sqrt(scale))
    if not len(live):
        return d, q
    dl, zl = d[live], z[live]
    gaps = np.append(np.diff(dl), zl @ zl)
    gap = dl[None, :] - dl[:, None]  # gap[j, i] = d_i - d_j
    z2 = zl * zl
    lo, hi = np.zeros(len(dl)), gaps.copy()
    for _ in range(STEPS):
        t = 0.5 * (lo + hi)
        f = 1.0 + (z2[None, :] / (gap - t[:, None])).sum(axis=1)
        right = f > 0
        hi = np.where(right, t, hi)
        lo = np.where(right, lo, t)
    t = 0.5 * (lo + hi)
    roots = dl + t
    # Loewner: the z for which the computed roots are exact; its vectors are orthogonal.
    towards = t[None, :] - gap.T  # towards[i, j] = l_j - d_i
    ratio = np.where(np.eye(len(dl), dtype=bool), towards, towards / np.where(gap.T == 0, 1.0, -gap.T))
    zhat = np.sign(zl) * np.sqrt(np.abs(np.prod(ratio, axis=1)))
    u = zhat[:, None] / (gap.T - t[None, :])  # u[i, j] = zhat_i / (d_i - l_j)
    u /= np.linalg.norm(u, axis=0, keepdims=True)
    d = d.copy()
    d[live] = roots
    q[:, live] = q[:, live] @ u
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def _spectrum_rows(d: np.ndarray, q: np.ndarray, slot: int) -> pd.DataFrame:
    return pd.DataFrame({"slot": [slot], "vals": [d.tolist()], "vecs": [q.ravel().tolist()]})


SPECTRUM = "slot BIGINT, vals ARRAY<DOUBLE>, vecs ARRAY<DOUBLE>"


def partition_spectra(vectors: DataFrame, n: int, sums: list[int], d: int) -> DataFrame:
    """One spectrum of the centred scatter matrix of each partition, from rank-one updates."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        vals, vecs = np.zeros(d), np.eye(d)
        for batch in batches:
            if not len(batch):
                continue
            rows = _centred(np.stack(batch["x"].to_numpy()), n, sums)
            for v in rows:
                vals, vecs = rank_one(vals, vecs, v)
        yield _spectrum_rows(vals, vecs, TaskContext.get().partitionId())

    return vectors.select("x").mapInPandas(fold, SPECTRUM)


def combined(spectra: DataFrame, d: int, fan: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Spectra merged in groups of ``fan`` by rank-one updates until one is left."""
    def merge(key, frame: pd.DataFrame) -> pd.DataFrame:
        vals, vecs = np.zeros(d), np.eye(d)
        for other_vals, other_vecs in zip(frame["vals"], frame["vecs"]):
            other_q = np.asarray(other_vecs).reshape(d, d)
            for j, value in enumerate(other_vals):
                if value > 0:
                    vals, vecs = rank_one(vals, vecs, np.sqrt(value) * other_q[:, j])
        return _spectrum_rows(vals, vecs, int(key[0]))

    while True:
        spectra = stored(spectra, "whiten-spectra")
        count = spectra.count()
        if count <= 1:
            break
        spectra = spectra.groupBy((F.col("slot") / fan).cast("bigint").alias("slot")).applyInPandas(
            lambda key, frame: merge(key, frame), SPECTRUM
        )
        # Partition ids are dense from 0, so each round divides the count by ``fan``.
    last = spectra.collect()
    if not last:
        return np.zeros(d), np.eye(d)
    return np.asarray(last[0]["vals"]), np.asarray(last[0]["vecs"]).reshape(d, d)


def rayleigh_ritz(vectors: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance, in the span of ``basis``."""
    q0, _ = np.linalg.qr(basis)
    d = q0.shape[0]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                y = _centred(np.stack(batch["x"].to_numpy()), n, sums) @ q0
                total += y.T @ y
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    parts = vectors.select("x").mapInPandas(project, "m ARRAY<DOUBLE>")
    rows = parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(d * d)
    for row in rows:
        m[row["i"]] = row["v"]
    m = m.reshape(d, d) / n
    m = 0.5 * (m + m.T)
    values, w = np.linalg.eigh(m)
    order = np.argsort(-values, kind="stable")
    values, comps = values[order], q0 @ w[:, order]
    comps /= np.linalg.norm(comps, axis=0, keepdims=True)
    # Sign: the entry of largest magnitude (first of equals) is positive.
    lead = np.argmax(np.abs(comps), axis=0)
    comps *= np.where(comps[lead, np.arange(d)] < 0, -1.0, 1.0)
    return np.maximum(values, 0.0), comps


def _whiten(x: np.ndarray, n: int, sums: list[int], comps: np.ndarray, values: np.ndarray) -> np.ndarray:
    root = np.sqrt(values)
    scale = np.where(root > 0, 1.0 / np.where(root > 0, root, 1.0), 0.0)
    return (_centred(x, n, sums) @ comps) * scale


OUT = "vec_id BIGINT, component INT, deviation BIGINT, whitened DOUBLE"


def whitened(embeddings: DataFrame, fan: int = 16) -> DataFrame:
    """Every usable row's first ``min(32, d)`` whitened components, with the fit's figures.

    Columns: ``vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue``.
    """
    vectors, d = integer_vectors(embeddings)
    spark = embeddings.sparkSession
    schema = (
        "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, "
        "identity_error DOUBLE, eigenvalue DOUBLE"
    )
    if not d:
        return spark.createDataFrame([], schema)
    n, sums = exact_sums(vectors, d)
    if not n:
        return spark.createDataFrame([], schema)
    vals, vecs = combined(partition_spectra(vectors, n, sums, d), d, fan)
    values, comps = rayleigh_ritz(vectors, vecs, n, sums)
    k = min(COMPONENTS, d)
    values_k, comps_k = values[:k], comps[:, :k]
    trace = float(values.sum())

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outer, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if len(batch):
                w = _whiten(np.stack(batch["x"].to_numpy()), n, sums, comps_k, values_k)
                outer += w.T @ w
                total += w.sum(axis=0)
        yield pd.DataFrame({"m": [[*outer.ravel().tolist(), *total.tolist()]]})

    parts = vectors.select("x").mapInPandas(moments, "m ARRAY<DOUBLE>")
    summed = np.zeros(k * k + k)
    for row in parts.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
        summed[row["i"]] = row["v"]
    mean = summed[k * k :] / n
    cov = summed[: k * k].reshape(k, k) / n - np.outer(mean, mean)
    kept = values_k > 0
    error = float(np.abs(cov - np.eye(k))[np.ix_(kept, kept)].max(initial=0.0))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            w = _whiten(np.stack(batch["x"].to_numpy()), n, sums, comps_k, values_k)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"].astype("Int64").repeat(k).to_numpy(),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch)),
                    "deviation": batch["deviation"].astype("Int64").repeat(k).to_numpy(),
                    "whitened": w.ravel(),
                }
            )

    total = F.lit(n).cast("decimal(38,0)")
    deviation = F.aggregate(
        F.zip_with("x", F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums]), lambda x, s: (total * x - s) * (total * x - s)),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, v: acc + v,
    ).cast("bigint")
    out = vectors.select("vec_id", deviation.alias("deviation"), "x").mapInPandas(rows, OUT)
    info = spark.createDataFrame(
        [(j + 1, float(values_k[j]), float(values_k[j] / trace) if trace > 0 else 0.0) for j in range(k)],
        "component INT, eigenvalue DOUBLE, explained DOUBLE",
    )
    return (
        out.join(F.broadcast(info), "component")
        .select(
            "vec_id",
            "component",
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            "whitened",
            "explained",
            F.lit(error).alias("identity_error"),
            "eigenvalue",
        )
    )
