"""Greedy CTC decoding of (crop_id, t, cls, val, box_w, seq_len) frames; class 0 is the blank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symbols(frames: DataFrame, charset: DataFrame) -> DataFrame:
    """Emitted symbols with t, chr, score and the time step their span starts at.

    A symbol is emitted where the class is not blank and not the one before. A span starts at the last other symbol's
    step, or one after the first blank of the last run of blanks; classes without a character emit nothing but move it.
    """
    one = Window.partitionBy("crop_id").orderBy("t")
    before = F.lag("cls", 1, 0).over(one)
    rows = frames.withColumn("before", before)
    new = (F.col("cls") != 0) & (F.col("cls") != F.col("before"))
    moved = F.when(new, F.col("t")).when((F.col("cls") == 0) & (F.col("before") != 0), F.col("t") + 1)
    start = F.coalesce(F.last(moved, True).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", start).where(new)
    return rows.join(F.broadcast(charset.select(F.col("idx").alias("cls"), "chr")), "cls").withColumn("score", 1 / (1 + F.exp(-F.col("val"))))


def text(emitted: DataFrame) -> DataFrame:
    """(crop_id, text, score): the symbols in order and their mean score; a crop without any gives no row."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "chr")))
    return emitted.groupBy("crop_id").agg(F.array_join(F.transform(ordered, lambda r: r["chr"]), "").alias("text"), F.avg("score").alias("score")).where("text != ''")


def spans(emitted: DataFrame) -> DataFrame:
    """(crop_id, t, chr, x, w): where each symbol stands in its box."""
    step = F.col("box_w") / F.col("seq_len")
    return emitted.select("crop_id", "t", "chr", (F.col("start") * step).alias("x"), ((F.col("t") - F.col("start") + 1) * step).alias("w"))
