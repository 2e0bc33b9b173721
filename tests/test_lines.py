"""Numbered lines of files read in many splits, vocabularies and dictionaries from them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from glintframe.operators import wordpiece
from glintframe.sources import lines, taxonomy


def small_splits(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "700")
    own.conf.set("spark.sql.files.openCostInBytes", "0")
    return own


def test_lines_of_split_files(spark, tmp_path):
    """Files far larger than a split, an empty one, one without a last line end, blank lines."""
    rng = random.Random(3)
    files = {f"{k}.txt": ["" if rng.random() < 0.2 else f" w{rng.randrange(50)}é{'x' * rng.randrange(40)}" for _ in range(n)] for k, n in enumerate([300, 0, 1, 120])}
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if rows and name != "3.txt" else ""))
    (tmp_path / "other.csv").write_text("not read")
    own = small_splits(spark)
    got = lines.text_lines(own, str(tmp_path), "*.txt")
    want = [r for name in sorted(files) for r in files[name]]
    assert [(r.id, r.line) for r in got.orderBy("id").collect()] == list(enumerate(want))
    assert own.read.text(str(tmp_path), pathGlobFilter="*.txt").rdd.getNumPartitions() > 10
    last = {r.strip(" "): k for k, r in enumerate(want)}
    last.pop("", None)
    assert {r.token: r.id for r in wordpiece.vocabulary(got).collect()} == last


def test_dictionary_file(spark, tmp_path):
    (tmp_path / "keys.txt").write_text("a\n　\nb\n \né\n")
    got = lines.charset(spark, str(tmp_path / "keys.txt")).orderBy("idx").collect()
    assert [(r.idx, r.chr) for r in got] == list(enumerate(["", "a", "　", "b", " ", "é", " "]))
    empty = tmp_path / "empty.txt"
    empty.write_text("")
    assert [(r.idx, r.chr) for r in lines.charset(spark, str(empty)).orderBy("idx").collect()] == [(0, ""), (1, " ")]


def test_numbers_follow_the_order(spark):
    """One value holds most rows; names that the operator could use itself pass through."""
    rng = random.Random(1)
    rows = [(1 if rng.random() < 0.8 else rng.randrange(100), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7).withColumn("n", F.lit("caller's")).withColumn("before", F.lit("caller's"))
    got = lines.numbered(df, "a", "b")
    assert [(r.a, r.b) for r in got.orderBy("number").collect()] == sorted(rows)
    assert sorted(r.number for r in got.collect()) == list(range(3000)) and got.columns == ["a", "b", "n", "before", "number"]
    assert lines.numbered(df.where("false"), "a").collect() == []


def test_taxonomy_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"name": "food", "icon": "f", "subs": ["soup", null, "rice"]}\n\nnot json\n{"name": "empty", "subs": []}\n{"icon": "no name", "subs": ["x"]}\n')
    (tmp_path / "b.jsonl").write_text('{"name": "food", "subs": ["soup"]}')
    got = [tuple(r) for r in taxonomy.taxonomy(spark, str(tmp_path), "*.jsonl").orderBy("cat_idx", "sub_idx").collect()]
    assert got == [(0, 0, "food", "f", "soup", "一张soup的照片"), (0, 2, "food", "f", "rice", "一张rice的照片"), (5, 0, "food", "", "soup", "一张soup的照片")]
