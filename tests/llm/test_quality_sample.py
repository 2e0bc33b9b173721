"""The size of the quality classifier's sample."""

from __future__ import annotations

from glintframe.llm import quality


def test_four_thousand_rows_vote(spark):
    docs = spark.range(8000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(8000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    rows = quality.labelled_rows(docs, labels)
    assert 3700 < rows.count() < 4300
    assert 3700 < len(quality.fit(rows).labels) < 4300
