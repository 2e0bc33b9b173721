"""Loaders of the input tables and builders of small literal tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-"))
    return _local[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of pictures, audio or points in the registered queries.
BATCH_BYTES = 4 << 20


def spread(df: DataFrame, key: str, each: int) -> DataFrame:
    """df dealt out by key, a partition for about `each` rows and at least the session's number: a table in one file of one row group is many tasks, too.

    Bounds the session's Arrow batches by bytes.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-df.count() // each), 32_768)), key)


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of constants as one VALUES relation: no Python rows are shipped."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v}D" if isinstance(v, float) else str(v)

    values = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes by image, from lineitem: (image_id, box_id, x, y, w, h, confidence).

    The four keys are grouped first, as they do not identify a row.
    """
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*keys[1:])) - 1
    return rows.select(
        F.col("l_orderkey").alias("image_id"),
        place.alias("box_id"),
        (F.col("l_partkey") % 200).cast("int").alias("x"),
        (F.col("l_suppkey") % 150).cast("int").alias("y"),
        (20 + F.col("q").cast("int") % 40).alias("w"),
        (20 + (F.col("l_partkey") * 7) % 50).cast("int").alias("h"),
        F.round(0.2 + F.col("d") * 4 + F.col("t") * 4, 4).alias("confidence"),
    )


#: The same boxes in DuckDB SQL.
BOXES_SQL = """boxes AS (
  SELECT l_orderkey AS image_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS box_id,
         CAST(l_partkey % 200 AS INTEGER) AS x, CAST(l_suppkey % 150 AS INTEGER) AS y, CAST(20 + CAST(trunc(q) AS INTEGER) % 40 AS INTEGER) AS w,
         CAST(20 + (l_partkey * 7) % 50 AS INTEGER) AS h, round(0.2 + d * 4 + t * 4, 4) AS confidence
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t FROM lineitem GROUP BY ALL))"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as laid-out text: (image_id, line_id from 0, text, x, y, w, h)."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.posexplode(F.split("text", "\n")).alias("line_id", "text"))
    n = F.length("text")
    return lines.select(
        "image_id",
        "line_id",
        "text",
        ((n * 37) % 300).cast("double").alias("x"),
        (F.col("line_id") * 40).cast("double").alias("y"),
        (n % 200).cast("double").alias("w"),
        (10 + n % 15).cast("double").alias("h"),
    )


LINES_SQL = r"""lines AS (
  SELECT image_id, line_id, text, CAST((length(text) * 37) % 300 AS DOUBLE) AS x, CAST(line_id * 40 AS DOUBLE) AS y,
         CAST(length(text) % 200 AS DOUBLE) AS w, CAST(10 + length(text) % 15 AS DOUBLE) AS h
  FROM (SELECT doc_id AS image_id, unnest(range(len(string_split(text, chr(10))))) AS line_id, unnest(string_split(text, chr(10))) AS text FROM documents))"""
