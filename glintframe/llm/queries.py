"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm import ann, common, decontaminate, langid, mixing, ngram_join, pq_dedup, quality, ranked, sharding, spm, substring, url_rules, whiten

#: The SentencePiece model of the tokenizer query.
SPM_MODEL = os.environ.get("GLINTFRAME_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by CRC-32 of the id's digits."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, in a prepared session."""
    common.prepared(spark)
    return common.table(spark, sf_dir, name)


#: The rules of the URL query.
URL_RULES = [
    url_rules.Rule("allow", "org/"),
    url_rules.Rule("block", "example.org/es/"),
    url_rules.Rule("block", "example.org/en/1"),
    url_rules.Rule("allow", "com/fr/"),
    url_rules.Rule("block", "com/de/"),
]


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The association rules learn from the URLs that the explicit rules judge."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fit = url_rules.explicit(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url")), URL_RULES)
    labelled = pages.select("url", fit["verdict"].alias("label")).where("label is not null")
    return url_rules.filtered(pages, URL_RULES, labelled).select("page_id", "host", "path", "rule", "verdict")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, prototypes = langid.fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), names, prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.fit(quality.labelled_rows(docs, labels.where(~held_out(F.col("doc_id")))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"), SPM_MODEL)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann, op2_ngram_jaccard, op3_url_filter, op4_sharding, op5_language_id, op6_quality, op7_pq_dedup, op8_mixing, op9_substring_dedup, op10_sentencepiece,
        op11_whitening, op12_decontamination, op13_ranked_search,
    )
}
