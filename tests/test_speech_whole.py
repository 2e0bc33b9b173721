"""Mixdown of a user with most of the events."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

from glintframe.plans import all_queries

START = dt.datetime(2024, 1, 1)


def events(n=3000, seed=6):
    rng = random.Random(seed)
    return [(k, START + dt.timedelta(seconds=rng.randrange(n)), 1 if rng.random() < 0.9 else rng.randrange(2, 9), float(rng.randrange(1000))) for k in range(n)]


def test_mixdown_of_a_heavy_user(spark, tmp_path):
    rows = events()
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    samples = defaultdict(list)
    for _, ts, user, value in sorted(rows, key=lambda r: (r[1], r[3])):
        samples[user].append((ts, value))
    want = {(u, i): round((v[2 * i][1] + (v[2 * i + 1][1] if 2 * i + 1 < len(v) else 0)) / 2, 6) for u, v in samples.items() for i in range((len(v) + 1) // 2)}
    df = all_queries.QUERIES["mono_mixdown"](spark, str(tmp_path))
    assert {(r.user_id, r.i): r.x for r in df.collect()} == want
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
