"""Prompts in many blocks: the rows of one block's path, ties, nulls, and a taxonomy of a million prompts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.operators import classify


def test_blocks_give_the_rows_of_one_block(spark):
    rng = np.random.default_rng(3)
    prompts = [(int(c), k, rng.integers(-3, 4, rng.integers(3, 7)).astype(float).tolist()) for k, c in enumerate(rng.integers(0, 9, 300))]
    prompts += [(3, 1000 + k, prompts[5][2]) for k in range(20)] + [(4, 2000, None), (None, 2001, [1.0]), (5, 2002, [0.0, 0.0]), (6, 2003, [None, 1.0])]
    vectors = [(k, rng.integers(-3, 4, rng.integers(2, 7)).astype(float).tolist()) for k in range(200)] + [(500, None), (501, [0.0]), (502, [None, 2.0])]
    tax = spark.createDataFrame(prompts, "cat_idx int, sub_idx long, v array<double>").repartition(5)
    df = spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(4)
    one = {(r.vec_id, r.cat_idx): (r.sub_idx, r.sim) for r in classify.best_prompts(df, tax).collect()}
    many = {(r.vec_id, r.cat_idx): (r.sub_idx, r.sim) for r in classify.best_prompts(df, tax, block=37, rows=50).collect()}
    assert set(one) == set(many) and len(one) == 202 * 9
    for key, (sub, sim) in one.items():
        assert many[key][1] == pytest.approx(sim, abs=1e-12)
        near = [s for s in (many[key][0], sub)]
        assert near[0] == near[1] or abs(many[key][1] - sim) < 1e-12


def test_a_million_prompts_are_not_collected(spark, monkeypatch):
    """A few vectors, each of which is one of the prompts; the driver holds no more than a block and one."""
    n, dims = 1_000_000, 4
    parts = [(F.sin((F.col("id") * (k * 7919 + 104_729) % 1_000_003).cast("double")) * 3).alias(f"x{k}") for k in range(dims)]
    tax = spark.range(n).select("id", *parts).select((F.col("id") % 3).cast("int").alias("cat_idx"), F.col("id").alias("sub_idx"), F.array(*(f"x{k}" for k in range(dims))).alias("v"))
    seen = []
    plain = type(tax).toArrow
    monkeypatch.setattr(type(tax), "toArrow", lambda self: seen.append(len(t := plain(self))) or t)
    wanted = [17, 500_003, 999_999]
    vectors = tax.where(F.col("sub_idx").isin(wanted)).select(F.col("sub_idx").alias("vec_id"), "v")
    got = classify.best_prompts(vectors, tax, block=100_000).collect()
    assert seen == [100_001] and len(got) == 9
    own = {r.vec_id: r.sim for r in got if r.cat_idx == r.vec_id % 3}
    assert all(sim == pytest.approx(1, abs=1e-9) for sim in own.values()) and set(own) == set(wanted)
