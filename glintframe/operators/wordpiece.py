"""WordPiece over a vocabulary that travels with the task, behind a check of its size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLS, SEP, UNKNOWN, CONTEXT, LONGEST = 101, 102, 100, 52, 200
MOST_ENTRIES = 1_000_000


def vocabulary(lines: DataFrame) -> DataFrame:
    """(token, id) of lines (id, line): lines are stripped, blank ones only use up an id, the last of equal ones wins."""
    token = F.trim(F.col("line"))
    return lines.select(token.alias("token"), "id").where("token != ''").groupBy("token").agg(F.max("id").alias("id"))


def pieces(word: str, known) -> list[str]:
    """Greedy longest pieces; what can't be matched ends in [UNK] after the pieces found. A word over 200 bytes is [UNK]."""
    if len(word.encode()) > LONGEST:
        return ["[UNK]"]
    out: list[str] = []
    start = 0
    while start < len(word):
        mark = "##" if start else ""
        end = next((e for e in range(len(word), start, -1) if mark + word[start:e] in known), None)
        if end is None:
            return [*out, "[UNK]"]
        out.append(mark + word[start:end])
        start = end
    return out


def splitter(vocab: DataFrame):
    """A Column function from an array of words to the array of their pieces."""
    rows = vocab.select("token").limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a vocabulary holds at most {MOST_ENTRIES} entries")
    known = {r["token"] for r in rows}

    @F.pandas_udf("array<string>")
    def split(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready: dict[str, list[str]] = {}
        for series in words:
            out = []
            for row in series:
                got: list[str] = []
                for word in () if row is None else row:
                    if word not in ready:
                        if len(ready) > 500_000:
                            ready.clear()
                        ready[word] = pieces(word, known)
                    got += ready[word]
                out.append(got)
            yield pd.Series(out)

    return split


def framed(ids: Column, context: int = CONTEXT) -> Column:
    """[CLS], at most context - 2 ids, [SEP], and zeros to the context's length."""
    inner = F.slice(ids, 1, context - 2)
    head = F.concat(F.array(F.lit(CLS).cast("long")), inner, F.array(F.lit(SEP).cast("long")))
    return F.concat(head, F.array_repeat(F.lit(0).cast("long"), F.lit(context) - F.size(head)))
