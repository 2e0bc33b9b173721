"""Recall of the two vector operators over uniform vectors, whose lists overlap most, and their hot groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import ann, pq_dedup, vectors


def unit(n, seed, dims=64):
    x = np.random.default_rng(seed).standard_normal((n, dims)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, labels=None):
    rows = [(k, v.tolist(), int(labels[k]) if labels is not None else k % 3) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(8)


@pytest.mark.parametrize("n, step", [(2_000, 20), (50_000, 500)])
def test_ann_recall(spark, n, step):
    x = unit(n, 1)
    x[7::1000] = x[0]  # copies
    got: dict[int, list] = {}
    for r in ann.search(frame(spark, x), F.col("vec_id") % step == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wide, hit, total = x.astype(np.float64), 0, 0
    for q in range(0, n, step):
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(n), d))[:10]
        assert len(got[q]) == 10 and len({k for k, _ in got[q]}) == 10
        assert all(s == pytest.approx(d[k], abs=1e-12) for k, s in got[q])
        hit += len(set(want.tolist()) & {k for k, _ in got[q]})
        total += 10
    assert hit / total >= 0.9
    print("recall", hit / total)


def test_ann_gives_k_where_there_are_k(spark):
    """Few rows in 64 dimensions, where the tests could abandon too many."""
    for n in (11, 12, 40, 85, 120):
        found = ann.search(frame(spark, unit(n, n)), F.lit(True)).groupBy("query_id").count().collect()
        assert len(found) == n and all(r["count"] == 10 for r in found)


def test_scan_never_returns_fewer(spark):
    rng = np.random.default_rng(4)
    rotation, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    index = ann.Index(np.zeros((1, 64)), rotation, 1)
    for n in range(11, 121, 6):
        x = unit(n, 100 + n).astype(np.float64)
        i, _, _ = ann.scan(index, x, np.arange(n), x, np.arange(n), 10)
        assert (np.bincount(i, minlength=n) == 10).all()


def brute(x, labels, least=0.93):
    n = len(x)
    wide = x.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    near = (wide @ wide.T >= least) & (labels[:, None] == labels[None]) & ~np.eye(n, dtype=bool)
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(near, root[None], n).min(1))
        if (low == root).all():
            return near.sum(1), root
        root = low


@pytest.mark.parametrize("n", [2_000, 6_000])
def test_pq_dedup_recall(spark, monkeypatch, n):
    """Near copies at cosines around the threshold, and a group of exact copies, over many lists."""
    monkeypatch.setattr(pq_dedup, "LIST_ROWS", 32)
    rng = np.random.default_rng(n)
    x = unit(n, 2)
    labels = rng.integers(0, 2, n)
    for k in range(0, n - 1, 4):
        cos = rng.uniform(0.9, 0.999)
        turn = rng.standard_normal(64)
        turn -= (turn @ x[k]) * x[k]
        x[k + 1] = cos * x[k] + np.sqrt(1 - cos**2) * turn / np.linalg.norm(turn)
        labels[k + 1] = labels[k]
    x[3::40] = x[3]
    labels[3::40] = 1
    want_n, want_root = brute(x, labels)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.near_duplicates(frame(spark, x, labels)).collect()}
    assert len(got) == n
    links = np.array([got[k][0] for k in range(n)])
    assert (links <= want_n).all() and links.sum() >= 0.99 * want_n.sum()
    copies = np.arange(3, n, 40)
    assert all(got[k][1] == 3 and got[k][0] >= len(copies) - 1 for k in copies)
    assert np.mean([got[k][1] == want_root[k] for k in range(n)]) >= 0.99
    assert all((c == k) == kept for k, (_, c, kept) in got.items())


def test_pq_dedup_recall_at_50_000_with_its_own_parameters(spark):
    """Near copies of every tenth vector; uniform vectors of 64 dimensions have no other links."""
    n, rng = 50_000, np.random.default_rng(7)
    x = unit(n, 3)
    first = np.arange(0, n, 10)
    cos = rng.uniform(0.9, 0.999, len(first))
    turn = rng.standard_normal((len(first), 64))
    turn -= (turn * x[first]).sum(1, keepdims=True) * x[first]
    x[first + 1] = cos[:, None] * x[first] + np.sqrt(1 - cos**2)[:, None] * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    a, b = (x[i].astype(np.float64) for i in (first, first + 1))
    linked = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= 0.93
    got = {r.vec_id: r.n_links for r in pq_dedup.near_duplicates(frame(spark, x, np.zeros(n))).where("n_links > 0").collect()}
    assert set(got) <= {int(v) for k in (0, 1) for v in first[linked] + k}
    assert len(got) >= 0.99 * 2 * linked.sum()


@pytest.mark.parametrize("ids", [(11, 22, 33), (99_997, 99_998, 99_999), (5, 50_000, 77_777, 80_001)])
def test_the_few_valid_of_very_many_rows(spark, ids):
    """All but a few of 100,000 vectors are zero, null or not finite: those few are found whatever their ids."""
    some = {0: "array(0f, 0f)", 1: "cast(null as array<float>)", 2: "array(float('nan'), 1f)", 3: "array(cast(null as float), 1f)"}
    odd = "case " + " ".join(f"when id % 4 = {k} then {v}" for k, v in some.items()) + " end"
    rows = spark.range(100_000).selectExpr("id as vec_id", f"case when id in {ids} then array(1f, 2f) else {odd} end as embedding", "1 as label")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(rows).where("n_links > 0").collect()}
    assert got == {i: (len(ids) - 1, ids[0]) for i in ids}
    found = ann.search(rows, F.lit(True)).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in found} == {(i, j, 0.0) for i in ids for j in ids if i != j}


def test_vectors_of_several_lengths(spark):
    """Each length is indexed by itself: equal vectors of a rare length are found and linked."""
    rows = [(k, [float(k), 1.0, 2.0], 1) for k in range(20)] + [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1), (102, [2.0, 4.1], 1), (103, [1.0], 1), (104, [], 1), (105, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("asks", F.lit("caller's"))
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") >= 100).collect()}
    assert found[100, 1] == (101, 0.0) and found[100, 2][0] == 102 and {q for q, _ in found} == {100, 101, 102}
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(df).collect()}
    assert got[100] == got[101] == got[102] == (2, 100) and got[103] == (0, 103) and got[104] == (0, 104) and got[105] == (0, 105)


def test_probes_cover_vectors_at_the_threshold():
    x = unit(4_000, 9).astype(np.float64)
    c = vectors.centers(x, 64)
    few, many = (pq_dedup.probes_for(x, c, 0.93, share) for share in (0.5, 0.995))
    assert 1 <= few <= many <= 64
