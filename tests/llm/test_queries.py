"""The registered queries against DuckDB at the smallest scale, and the pipeline against its parts."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from glintframe.llm import oracles, queries
from tests.llm.test_operators import brute_components, brute_removal, reach, shingles

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows_of(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(DATA))
    got = con.execute(oracles.SQL[name])
    names = [c[0] for c in got.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = queries.op5_language_id(spark, str(DATA)).where("held_out").join(docs, "doc_id").where("lang is not null")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95


def test_quality_on_held_out(spark):
    docs = queries.op6_quality(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = docs.select("score", "quality", "predicted").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95
    assert sum(r.predicted == 0 for r in rows if r.quality == 1) <= 0.03 * len(good)


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as pipe
    from glintframe.llm import spm

    sf = str(DATA)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = {r.doc_id: r.predicted for r in queries.op6_quality(spark, sf).collect()}
    one = pipe.quality_stage(spark, docs, sf)
    assert one.columns == docs.columns
    left = one.orderBy("doc_id").collect()
    assert {r.doc_id for r in left} == {k for k, v in scored.items() if v}
    rows = [(r.doc_id, r.text) for r in left]
    roots = brute_components(rows, 80, 5)
    two = pipe.ngram_stage(spark, spark.createDataFrame(left, docs.schema), sf).collect()
    assert {r.doc_id for r in two} == {d for d, _ in rows if roots[d][1] == d}
    cut = brute_removal([(r.doc_id, r.text) for r in two])
    three = pipe.substring_stage(spark, spark.createDataFrame(two, docs.schema), sf).collect()
    text = {r.doc_id: r.text for r in two}
    assert {r.doc_id for r in three} == {d for d, (n, gone, _) in cut.items() if not gone or gone < n}
    for r in three:
        assert (r.text == text[r.doc_id]) == (cut[r.doc_id][1] == 0) and r.n_chars == len(r.text)
    final = pipe.run(spark, sf)
    codec = spm.codec(queries.SPM_MODEL)
    got = final.collect()
    assert got and {r.doc_id for r in got} <= {r.doc_id for r in three}
    assert all(codec.decode(r.ids) == r.text and r.n_ids == len(r.ids) for r in got)


def test_ngram_stage_takes_five_words_and_four_fifths(spark):
    """Copies between the two thresholds: ten spread edits in 500 words, one in 55; and twelve edits in 500, which stay."""
    import corpus_pipeline as pipe

    def edited(words, places):
        return " ".join(f"x{k}" if k in places else w for k, w in enumerate(words))

    long, short = [f"w{k}" for k in range(500)], [f"v{k}" for k in range(55)]
    texts = [" ".join(long), edited(long, range(25, 500, 50)), " ".join(short), edited(short, {27}), edited(long, range(20, 500, 40)), "v0 v1 v2", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (made, spark.read.parquet(f"{DATA}/documents.parquet")):
        sets = {r.doc_id: shingles(r.text, 5) for r in docs.collect()}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        root = reach(sets, links)
        assert sorted(r.doc_id for r in pipe.ngram_stage(spark, docs, str(DATA)).collect()) == sorted(d for d in root if root[d] == d)
