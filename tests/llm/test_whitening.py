"""Whitening against a plain eigendecomposition in numpy, and its odd rows."""

import math

import numpy as np
import pytest

from msgpulse.llm import whitening
from msgpulse.llm.queries import QUERIES

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def plain(rows):
    """Rows kept, and the components of their covariance, by numpy on one machine."""
    kept = [
        (i, v)
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    ids = [i for i, _ in kept]
    x = np.floor(64 * np.array([v for _, v in kept], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    centred = x - x.sum(axis=0) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return ids, x, centred, values[order], vectors[:, order]


def check(spark, rows, parts=4):
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(parts)).toPandas()
    ids, x, centred, values, vectors = plain(rows)
    n, d = x.shape
    k = min(32, d)
    assert len(got) == n * k
    assert set(got["n"]) == {n}
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    want = (centred @ vectors[:, :k]) / np.sqrt(values[:k])
    got = got.sort_values(["vec_id", "component"])
    table = got["whitened"].to_numpy().reshape(n, k)
    order = np.argsort(ids, kind="stable")
    # Either sign, the same for all rows.
    signs = np.sign((table * want[order]).sum(axis=0))
    assert np.abs(table - want[order] * signs).max() < 1e-8
    assert np.array_equal(got["deviation"].to_numpy().reshape(n, k)[:, 0], deviation[order])
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(explained / (values[:k] / values.sum()) - 1).max() < 1e-4
    assert got["identity_error"].iloc[0] < 1e-4
    return got


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(k, [float(c) for c in base[k]]) for k in range(300)]
    check(spark, rows, parts=7)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=6)]) for k in range(40)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [float("nan")] * 6), (103, [float("inf")] * 6)]
    rows += [(5, rows[5][1]), (None, rows[6][1])]  # a repeated id and a missing one give rows too
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)).toPandas()
    assert len(got) == 42 * 6
    assert not set(got["vec_id"].dropna()) & {100, 101, 102, 103}
    assert got["vec_id"].isna().sum() == 6
    assert (got["vec_id"] == 5).sum() == 12


def test_other_lengths_take_no_part(spark):
    rows = [(k, [float(k % 5), float(k % 3), float(k % 7)]) for k in range(30)] + [(99, [1.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).toPandas()
    assert len(got) == 30 * 3 and 99 not in set(got["vec_id"])


def test_rank_deficient_and_tiny_tables(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0)], SCHEMA)).toPandas()
    assert len(one) == 4 and (one["whitened"] == 0).all() and (one["deviation"] == 0).all()
    empty = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and "identity_error" in empty.columns
    assert whitening.whitened(spark.createDataFrame([(1, None, 0)], SCHEMA)).count() == 0


def test_rank_one_update_keeps_an_exact_decomposition():
    rng = np.random.default_rng(1)
    d, q, total = np.zeros(5), np.eye(5), np.zeros((5, 5))
    for v in [*rng.normal(size=(20, 5)), np.zeros(5), np.array([1.0, 0, 0, 0, 0])]:
        d, q = whitening.rank_one(d, q, v)
        total += np.outer(v, v)
        assert np.abs(q @ np.diag(d) @ q.T - total).max() < 1e-9 * max(1, np.abs(total).max())
        assert np.abs(q.T @ q - np.eye(5)).max() < 1e-10


@pytest.mark.parametrize("parts", [1, 5])
def test_query_over_the_table(spark, parts):
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001")
    assert {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"} <= set(got.columns)
    assert got.select("identity_error").first()[0] < 1e-4
