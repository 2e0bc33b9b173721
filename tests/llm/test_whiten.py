"""Whitening against NumPy, and odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import queries, whiten

ROWS = "vec_id long, embedding array<double>"


def brute(vectors: np.ndarray, k: int):
    """(n, deviations, whitened, explained) of all rows, the fit list being the distinct ones."""
    x = np.floor(64 * vectors).astype(object).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ w / np.sqrt(e), e / np.trace(v)


def table_of(out, k):
    rows = out.collect()
    z, far = {}, {}
    for r in rows:
        z.setdefault(r.vec_id, [None] * k)[r.component - 1] = r.whitened
        far[r.vec_id] = r.deviation
    return rows, z, far


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) * 3
    vectors = np.concatenate([base, base[:1].repeat(80, 0)])  # one vector makes up more than half of all rows
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], ROWS).repartition(5)
    n, far, z, explained = brute(vectors, 4)
    rows, got, got_far = table_of(whiten.whitened(df, components=4), 4)
    assert len(rows) == 4 * len(vectors) and {r.n for r in rows} == {n}
    own = np.array([got[i] for i in range(len(vectors))])
    sign = np.sign((own * z).sum(0))
    assert np.abs(own * sign - z).max() < 1e-9
    assert [got_far[i] for i in range(len(vectors))] == far.tolist()
    assert {r.component: r.explained for r in rows} == pytest.approx(dict(enumerate(explained, 1)), rel=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_the_query_over_its_whole_table(spark):
    data = "/root/testdata/sf0.001"
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, far, z, explained = brute(np.array([vectors[i] for i in ids], float), 16)
    rows, got, got_far = table_of(queries.op11_whitening(spark, data), 16)
    own = np.array([got[i] for i in ids])
    assert len(rows) == 16 * len(ids) and rows[0].n == n
    assert np.abs(own * np.sign((own * z).sum(0)) - z).max() < 1e-6
    assert [got_far[i] for i in ids] == far.tolist()
    assert rows[0].identity_error < 1e-6


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (1, [1.0, 2.0]), (2, [3.0, -4.0]), (2, [0.5, 0.25]), (None, [1.0, 2.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]),
        (7, [1.0, -inf]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 0.0]), (2**53 + 1, [7.0, 7.0]),
    ]
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("caller's") for c in ("x", "z", "n", "deviation", "component", "at")})
    out = whiten.whitened(df).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out) == sorted((i is None, i or 0, c) for i in (1, 2, 2, None, 2**53 + 1) for c in (1, 2))
    assert {r.n for r in out} == {4}
    same = {(r.vec_id, r.component): r.whitened for r in out if r.vec_id in (1, None)}
    assert [same[1, c] for c in (1, 2)] == pytest.approx([same[None, c] for c in (1, 2)])


def test_no_variance_and_no_rows(spark):
    one = whiten.whitened(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], ROWS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, 0.0)] * 4
    line = whiten.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], ROWS)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and {r.component for r in line} == {1, 2, 3}
    assert line[0].identity_error < 1e-9
    for rows in ([], [(1, None), (2, [])]):
        empty = whiten.whitened(spark.createDataFrame(rows, ROWS))
        assert empty.collect() == [] and empty.dtypes == whiten.whitened(spark.createDataFrame([(1, [1.0])], ROWS)).dtypes


def test_entries_beyond_64_bits_of_squares(spark):
    """Sums stay exact where squares no longer fit; such a deviation is null."""
    big = 2.0**40
    rows = [(1, [big, 1.0]), (2, [-big, 2.0]), (3, [big / 2, 5.0]), (4, [0.015625, 9.0])]
    out = {r.vec_id: r for r in whiten.whitened(spark.createDataFrame(rows, ROWS), components=1).collect()}
    x = {i: [int(v * 64) for v in e] for i, e in rows}
    total = [sum(v[d] for v in x.values()) for d in range(2)]
    far = {i: sum((4 * v[d] - total[d]) ** 2 for d in range(2)) for i, v in x.items()}
    assert {i: r.deviation for i, r in out.items()} == {i: f if f < 2**63 else None for i, f in far.items()}
    assert sum(r.whitened for r in out.values()) == pytest.approx(0, abs=1e-9)
    assert sum(r.whitened**2 for r in out.values()) / 4 == pytest.approx(1)
