"""A corpus pipeline of five stages; each writes Parquet that the next one reads.

run() applies STAGES to `documents`. Between stages a table is written to the shared
folder named in spark.checkpoint.dir.

All stages: an empty table gives an empty one; texts are taken whole, of any length;
columns of documents pass through, further ones too, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm import common, mixing, ngram_join, quality, spm, substring
from glintframe.llm.queries import SPM_MODEL, quality_model, table


def aside(docs: DataFrame, *new: str) -> tuple[DataFrame, list[Column]]:
    """docs with those of its columns renamed that an operator would replace, and the columns that bring docs' own names back."""
    names = []
    for c in docs.columns:
        names.append(common.free(docs.toDF(*names, *docs.columns[len(names) :]), "own_" + c) if c.lower() in new else c)
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts score the share of good labels, so they stay unless labels are mostly
    bad; equal texts share one fate; a null doc_id doesn't matter.
    """
    rows, own = aside(docs, "score", "predicted")
    scored = quality.score(rows, quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 1").select(*own)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

    Null and empty texts and rows without a doc_id stay, as they link with nothing. Of rows that share
    a doc_id all stay or all go.
    """
    return ngram_join.one_of_each(docs, words=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages repeated from earlier documents; a text without any stays as it is, one with nothing left is dropped.

    Null and empty texts stay; rows without a doc_id keep all their words; rows that share a doc_id
    take nothing from each other.
    """
    docs, own = aside(docs, "n_words", "n_removed", "kept", "kept_sha256")
    cut = substring.removal(docs)
    whole = F.col("n_removed") == 0
    rows = cut.where(whole | (F.col("kept") != ""))
    new = {"text": F.when(whole, F.col("text")).otherwise(F.col("kept")), "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length("kept").cast("long"))}
    return rows.withColumns({c: v for c, v in new.items() if c in docs.columns}).select(*own)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources wants it, at most 3 times on average over a source.

    A null source is a source of its own; null and empty texts have size 0; each of equal rows is taken by itself.
    """
    return mixing.mix(docs)


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids and their number; a null text has null in both. Columns `ids` and `n_ids` of docs are replaced."""
    return spm.encoded(docs, SPM_MODEL).withColumn("n_ids", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", ngram_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", tokenize_stage),
]

#: The quality classifier's votes and the tokenizer's automaton can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
