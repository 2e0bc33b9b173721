"""Ranked search against brute force, and odd rows."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import ranked

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    held = [(d, t) for d, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in {(i, tuple(sorted(set(terms(x))))) for i, x in items}:
        scored = []
        for d, t in held:
            m = 50 + (50 * len(t) * n_docs) // n_terms
            score = 0
            for w in text:
                if tf := t.count(w):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(60)] + ["É", "zwölf", "A1"]
    text = lambda most: " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(63)], k=rng.randrange(0, most)))
    docs = [(k, text(40)) for k in rng.sample(range(10_000), n)]
    items = [(k, text(12)) for k in range(20)]
    return docs, items


@pytest.mark.parametrize("block", [50_000, 15])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK", block)
    docs, items = corpus(block, 400)
    same = docs[0][1] + " t1 t2 t50"
    docs += [(20_000 - k, same) for k in range(90)]  # ties by the dozen, larger than k
    docs += [(None, same), (None, None), (5, None), (6, ""), (7, " ,.-"), (docs[1][0], docs[1][1]), (docs[1][0], "t50")]
    items += [(30, same), (31, None), (32, "unheard of"), (33, "--"), (3, items[3][1]), (3, "t50 T50"), (None, "t50")]
    df = ranked.ranked(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(items, ITEMS), 13)
    assert got(df) == brute(docs, items, 13)


def test_tree_holds_the_maxima_and_search_opens_no_more_than_needed():
    rng = np.random.default_rng(2)
    n, width = 3000, 40
    counts = rng.integers(0, 9, n)
    term = np.concatenate([np.sort(rng.choice(width, c, False)) for c in counts]).astype(np.int64)
    score = rng.integers(1, 50, len(term))
    start = np.concatenate([[0], np.cumsum(counts)])
    dense = np.zeros((n, width), np.int64)
    dense[np.repeat(np.arange(n), counts), term] = score
    levels = ranked.tree(ranked.Level(start, term, score), width)
    assert levels[-1].nodes() == 1
    for k, level in enumerate(levels[1:], 1):
        for node in range(level.nodes()):
            want = dense[node * ranked.FAN**k : (node + 1) * ranked.FAN**k].max(0)
            have = np.zeros(width, np.int64)
            have[level.term[level.start[node] : level.start[node + 1]]] = level.score[level.start[node] : level.start[node + 1]]
            assert (want == have).all()
    opened = []
    plain = ranked.Level.sums

    class Counted(ranked.Level):
        def sums(self, a, b, asked):
            opened.append((a, b))
            return plain(self, a, b, asked)

    counted = [Counted(x.start, x.term, x.score) for x in levels]
    asked = np.zeros(width, bool)
    asked[[3, 5]] = True
    best: list = []
    ranked.search(counted, asked, list(range(n)), best, 5)
    every = [(-int(s), i) for i, s in enumerate(dense[:, [3, 5]].sum(1)) if s]
    want = sorted(every)[:5]
    assert sorted((-s, -d) for s, d in best) == want
    assert len(opened) < 0.5 * n / ranked.FAN
    before = len(opened)
    ranked.search(counted, asked, list(range(n, 2 * n)), best, 5)  # the same documents under larger ids, which lose ties
    assert sorted((-s, -d) for s, d in best) == sorted([*every, *((s, i + n) for s, i in every)])[:5] and len(opened) > before + 1


def test_empty_tables_long_texts_and_other_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b " * 50_000), (2, "b")], DOCS), spark.createDataFrame([(1, "a b"), (2, "c")], ITEMS)
    assert got(ranked.ranked(docs, items)) == brute([(1, "a b " * 50_000), (2, "b")], [(1, "a b"), (2, "c")], 50)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        out = ranked.ranked(d, i)
        assert out.collect() == [] and out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    more = {c: F.lit("x") for c in ("words", "n", "terms", "counts", "m", "item", "score", "rank")}
    assert got(ranked.ranked(docs.withColumns(more), items.withColumns(more))) == got(ranked.ranked(docs, items))
