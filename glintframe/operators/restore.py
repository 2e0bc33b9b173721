"""Mending texts of a recognizer: lost spaces, run-together words and misread letters, by a table of word frequencies.

The steps over a text, as SQL-like expressions but for the splitting of runs: a gate
says whether the text is spaced well already; spaces lost between kinds of characters
come back; long runs of letters are split into the likeliest words; unknown words give
way to the nearest known one; and the text is put together again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions import text as X
from glintframe.operators.segment import Splitter, trie

# Least frequency of a word that corrects another; letters of a word that is corrected; letters of a run that is not split.
LEAST, SHORTEST, LONGEST, RUN = 5e-7, 5, 20, 7
EDITS = 2


def frequencies(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(word, freq) of the lower-cased words of letters of (text), as shares of all: over `least`, so at most 1 / least words."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).groupBy("word").count()
    total = words.agg(F.sum("count").alias("total"))
    return words.join(F.broadcast(total), F.lit(True)).select("word", (F.col("count") / F.col("total")).alias("freq")).where(F.col("freq") > least)


def ranked(words: DataFrame) -> list[str]:
    """The words of a frequency table, the most frequent first; the table's bound holds for the list."""
    return words.orderBy(F.desc("freq"), "word").select("word").toArrow().column("word").to_pylist()


def split_runs(text: str, words: Splitter) -> str:
    """The text with runs of more than RUN letters and apostrophes split into words; letters keep their case."""

    def one(m: re.Match) -> str:
        run, out, at = m[0], [], 0
        for piece in words.split(run.lower()):
            out.append(run[at : at + len(piece)])
            at += len(piece)
        return " ".join(out)

    return re.sub(rf"[a-zA-Z']{{{RUN + 1},}}", one, text)


def run_splitter(spark: SparkSession, words: list[str]):
    """A Column function that splits the runs of texts; the words go out once, as a broadcast trie."""
    sent = spark.sparkContext.broadcast(trie(words))

    @F.pandas_udf("string")
    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Splitter(sent.value)
        for series in texts:
            yield series.map(lambda t: None if t is None else split_runs(t, known))

    return split


def _deleted(word: Column) -> Column:
    """The word without up to EDITS of its letters: words within that many edits share one of these."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    out = level = F.array(word)
    for _ in range(EDITS):
        level = F.array_distinct(F.flatten(F.transform(level, less)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def corrections(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(low, word): of each unknown lower-cased word (low: distinct) the known one with the fewest edits, at most EDITS; then the most frequent, then the first."""
    known = words.where((F.length("word") >= SHORTEST - EDITS) & (F.length("word") <= LONGEST + EDITS))
    met = unknown.select("low", F.explode(_deleted(F.col("low"))).alias("part")).join(known.select("word", "freq", F.explode(_deleted(F.col("word"))).alias("part")), "part")
    near = met.select("low", "word", "freq").distinct().withColumn("edits", F.levenshtein("low", "word")).where(F.col("edits") <= EDITS)
    best = F.min(F.struct("edits", (-F.col("freq")).alias("rare"), "word"))
    return near.groupBy("low").agg(best["word"].alias("word"))


def _worth(token: Column) -> Column:
    """Whether a token of letters may be corrected: long enough, not too long, not all capitals."""
    return F.length(token).between(SHORTEST, LONGEST) & (token != F.upper(token))


def spelled(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts (id, text) with unknown words of 5 to 20 letters, not all capitals, corrected in their own case.

    Only unknown words are shuffled, not texts' tokens. A null text stays null.
    """
    tokens = F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))
    worth = F.array_distinct(F.transform(F.filter(tokens, _worth), F.lower))
    asked = texts.select("id", F.explode(worth).alias("low")).join(words.select(F.col("word").alias("low")), "low", "left_anti")
    found = asked.join(corrections(asked.select("low").distinct(), words), "low")
    maps = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("low", "word"))).alias("fixes"))
    parts = F.regexp_extract_all("text", F.lit("[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))

    def fixed(token: Column) -> Column:
        word = F.try_element_at("fixes", F.lower(token))
        return F.when(word.isNotNull() & _worth(token), X.case_like(token, word)).otherwise(token)

    whole = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(F.array_join(F.transform(parts, fixed), ""))
    return texts.join(maps, "id", "left").select("id", whole.alias("text"))


def restored(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(id, text) mended, from texts (id: unique, text) and a frequency table (word, freq).

    Short or well-spaced texts are only spelled; mostly CJK ones stay as they are. A null text stays null.
    """
    gate = texts.withColumn("gate", X.space_gate(F.col("text")))
    mended = run_splitter(texts.sparkSession, ranked(words))(X.spaced(F.col("text")))
    spaced = gate.select("id", "gate", F.when(F.col("gate") == "mend", mended).otherwise(F.col("text")).alias("text"))
    kept = spaced.where("gate = 'keep' or gate is null").select("id", "text")
    return spelled(spaced.where("gate != 'keep'").select("id", "text"), words).unionByName(kept)
