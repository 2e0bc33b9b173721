"""Paragraphs of text lines: a range join of lines, components, and ids in reading order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERLAP, GAP = 0.5, 1.5


def paragraph_edges(lines: DataFrame) -> DataFrame:
    """(image_id, a, b): lines of one image, a before b by (y, x, line_id), whose x ranges share half of the narrower one
    and whose gap is at most 1.5 mean heights. Lines without width have none.

    Lines meet in bands of y as high as the image's lines can reach, so a tall page is not joined with itself.
    """
    reach = F.max("h").over(Window.partitionBy("image_id")) * (1 + GAP) + 1e-9
    rows = lines.where("w > 0").withColumn("reach", reach).withColumn("band", F.floor(F.col("y") / F.greatest("reach", F.lit(1e-9))))
    a = rows.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).alias("a")
    b = rows.alias("b")
    c = F.col
    order = F.struct(c("a.y"), c("a.x"), c("a.line_id")) < F.struct(c("b.y"), c("b.x"), c("b.line_id"))
    shared = F.least(c("a.x") + c("a.w"), c("b.x") + c("b.w")) - F.greatest(c("a.x"), c("b.x"))
    wide = F.greatest(shared, F.lit(0.0)) / F.least(c("a.w"), c("b.w")) >= OVERLAP
    near = F.greatest(c("b.y") - c("a.y") - c("a.h"), F.lit(0.0)) <= (c("a.h") + c("b.h")) / 2 * GAP
    met = a.join(b, (c("a.image_id") == c("b.image_id")) & (c("a.band") == c("b.band")) & order & wide & near)
    return met.select(c("a.image_id").alias("image_id"), c("a.line_id").alias("a"), c("b.line_id").alias("b"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(image_id, line_id, paragraph_id): components of the edges, numbered from 0 by their first line in (y, x) order."""
    edges = paragraph_edges(lines).groupBy("image_id").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    order = F.struct("y", "x", "line_id")
    whole = lines.groupBy("image_id").agg(F.array_sort(F.collect_list(order)).alias("lines")).join(edges, "image_id", "left")

    @F.pandas_udf("array<struct<line_id:int,paragraph_id:int>>")
    def number(all_lines: pd.Series, all_edges: pd.Series) -> pd.Series:
        out = []
        for rows, links in zip(all_lines, all_edges, strict=True):
            parent = {r["line_id"]: r["line_id"] for r in rows}

            def find(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            for e in () if links is None else links:
                parent[find(e["b"])] = find(e["a"])
            ids: dict[int, int] = {}
            out.append([{"line_id": r["line_id"], "paragraph_id": ids.setdefault(find(r["line_id"]), len(ids))} for r in rows])
        return pd.Series(out)

    numbered = whole.select("image_id", F.explode(number("lines", "edges")).alias("r"))
    return numbered.select("image_id", "r.line_id", "r.paragraph_id")
