"""Numbered lines: of text files, as vocabularies and dictionaries need them, and of any rows in an order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.sources.tables import shared_folder


def _offsets(counts: DataFrame, *order: str) -> DataFrame:
    """What is to be added to a row's __at for its number, from counts (__n, __first and what orders them; one row a part of the data)."""
    earlier = F.sum("__n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return counts.select(*order, (F.coalesce(earlier, F.lit(0)) - F.col("__first")).cast("long").alias("__shift"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number`, their place from 0 in the order of the columns `order` (ties in any order).

    Rows are dealt out by ranges of the order; a row's number is its place within its range after
    the rows of the ranges before. One count a range meets in one task, never the rows.
    """
    spark = rows.sparkSession
    home = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).write.parquet(home)
    kept = spark.read.parquet(home)
    ranges = _offsets(kept.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")), "__range")
    return kept.join(F.broadcast(ranges), "__range").select(*rows.columns, (F.col("__at") + F.col("__shift")).alias("number"))


def text_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(id, line): lines of the text files under a path, numbered from 0 through the files by name.

    Files of any size are read in splits by many tasks; a line's number is its place in its split
    after the lines of the splits before.
    """
    home = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    spots = lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    spots.withColumn("__at", F.monotonically_increasing_id()).write.parquet(home)
    kept = spark.read.parquet(home)
    splits = _offsets(kept.groupBy("file", "start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")), "file", "start")
    return kept.join(F.broadcast(splits), ["file", "start"]).select((F.col("__at") + F.col("__shift")).alias("id"), "line")


def charset(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(idx, chr) of a recognizer's dictionary file: blank at 0, lines as they are from 1, a space at the end."""
    return framed(text_lines(spark, path, glob).select((F.col("id") + 1).alias("idx"), F.col("line").alias("chr")))


def framed(lines: DataFrame) -> DataFrame:
    """Lines (idx from 1, chr) with the blank before and the space behind."""
    blank = lines.sparkSession.range(1).select(F.lit(0).cast("long").alias("idx"), F.lit("").alias("chr"))
    last = lines.agg((F.coalesce(F.max("idx"), F.lit(0)) + 1).cast("long").alias("idx")).select("idx", F.lit(" ").alias("chr"))
    return blank.unionByName(lines.select(F.col("idx").cast("long").alias("idx"), "chr")).unionByName(last)
