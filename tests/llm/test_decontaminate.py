"""Contaminated words against brute force, and odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glintframe.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window):
    out = []
    grams = [(i, {tuple(w[p : p + window]) for p in range(max(len(w) - window + 1, 1))}) for i, t in items if (w := words(t))]
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, own in grams:
            for g in own:
                for p in range(len(w) - len(g) + 1):
                    if tuple(w[p : p + len(g)]) == g:
                        hit |= set(range(p, p + len(g)))
                        found |= {str(item)} if item is not None else set()
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.mark.parametrize("window, shingle", [(10, 5), (4, 2), (3, 5), (1, 1)])
def test_against_brute_force(spark, window, shingle):
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice(["ab", "Ab", "c", "é", "7", "x-y"]) for _ in range(n))
    items = [(k, text(rng.randrange(0, 14))) for k in range(12)] + [(3, "ab ab c"), (100, None), (101, " - "), (None, "c c c c c c c c c c c")]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)]
    docs += [(900 + k, text(9) + " " + (items[k][1] or "") + "! " + text(9)) for k in range(12)]
    docs += [(2000, None), (2001, ""), (2002, "..."), (7, "ab"), (7, docs[7][1]), (None, docs[8][1])]
    want = brute(docs, items, window)
    assert any(r[3] > 1 for r in want)
    df = decontaminate.contamination(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), window, shingle)
    assert got(df) == want


def test_a_hot_text_a_long_text_and_shuffled_joins(spark, monkeypatch):
    """Half of the rows are one text; a text of 60,000 words holds a passage at its end; nothing is broadcast by a hint."""
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    passage = " ".join(f"w{k}" for k in range(25))
    docs = [(k, f"one two {passage} three") for k in range(300)] + [(1000 + k, f"clean text number {k} " * 8) for k in range(299)]
    docs += [(5000, " ".join(f"v{k % 977}" for k in range(60_000)) + " " + passage)]
    items = [(k, passage) for k in range(30)] + [(50, "nowhere " * 12), (51, "v1 v2 v3")]
    out = {r[0]: r[1:] for r in got(decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))}
    assert all(out[k][:3] == (28, 25, 30) for k in range(300)) and not any(out[1000 + k][-1] for k in range(299))
    assert out[5000][:3] == (60_025, 25 + 3 * 62, 31)


def test_empty_tables_and_callers_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, "A, b.")], ITEMS)
    none, no_items = docs.where("false"), items.where("false")
    assert got(decontaminate.contamination(none, items)) == []
    assert got(decontaminate.contamination(docs, no_items)) == brute([(1, "a b c")], [], 10)
    names = ["key", "words", "found", "at", "h", "n", "window", "size", "candidates", "ids", "item_id", "_key"]
    clash = docs.withColumns({c: F.lit(f"caller's {c}") for c in names}).withColumn("N_HIT", F.lit(-1))
    out = decontaminate.contamination(clash, items.withColumns({c: F.lit("x") for c in names if c != "item_id"}))
    row = out.first()
    assert all(row[c] == f"caller's {c}" for c in names) and row["n_hit"] == 2 and out.columns.count("n_hit") == 1 and "N_HIT" not in out.columns


def test_no_python_on_the_path(spark):
    df = decontaminate.contamination(spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, "a b")], ITEMS))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
