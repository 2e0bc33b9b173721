"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source stand in a seeded shuffle. A row's fractional rank is its place
in that order, with an offset for its source, over the number of the source's rows.
Sorted by it, all sources advance in step, and equal cuts give every shard the whole
mixture. Places come from counts of cells of the hash (within the source) and of the
fraction (over all), so no source and no sort meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm import common
from glintframe.llm.mixing import order_hash, seed_hash


def _before(*by: str):
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _hex(column: str, at: int, n: int):
    return F.conv(F.substring(column, at, n), 16, 10)


def shards(docs: DataFrame, n_shards: int = 24, seed: str = "shard") -> DataFrame:
    """Each row's place: doc_id, size, text_crc32, source, fraction, position, shard and slot.

    size: UTF-8 bytes of the text (null: none) plus 8. text_crc32 of a null text is
    null. Shards hold equal numbers of rows, or one apart ("rows"). A null source is a
    source of its own; rows without a doc_id stand by their text; equal rows get places
    of their own (ties of all of fraction, source, hash, doc_id, size and CRC-32 are
    interchangeable); an empty table gives none. Other columns of docs play no part.
    """
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), order_hash(seed).alias("h"))
    rows = rows.withColumn("hi", _hex("h", 1, 2).cast("int")).withColumn("lo", _hex("h", 3, 2).cast("int"))
    rows = common.written(rows)
    cells = rows.groupBy("source", "hi", "lo").agg(F.count("*").alias("n"))
    groups = cells.groupBy("source", "hi").agg(F.sum("n").alias("n"))
    sources = groups.groupBy("source").agg(F.sum("n").alias("source_n"))
    zero = F.lit(0).cast("long")
    g = groups.select("source", "hi", F.coalesce(F.sum("n").over(_before("source", "hi")), zero).alias("at_hi"))
    g = g.join(sources, g["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    c = cells.select("source", "hi", "lo", F.coalesce(F.sum("n").over(_before("source", "hi", "lo")), zero).alias("at_lo"))
    c = c.join(g, c["source"].eqNullSafe(g["source"]) & (c["hi"] == g["hi"])).drop(g["source"]).drop(g["hi"])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "hi", "lo").orderBy("h", "doc_id", "size", "text_crc32")))
    r = ranked.join(c, ranked["source"].eqNullSafe(c["source"]) & (ranked["hi"] == c["hi"]) & (ranked["lo"] == c["lo"])).drop(c["source"]).drop(c["hi"]).drop(c["lo"])
    offset = _hex_of_source(seed)
    fraction = (F.col("at_hi") + F.col("at_lo") + F.col("rank") - 1 + offset) / F.col("source_n")
    placed = r.select("doc_id", "source", "size", "text_crc32", "h", fraction.alias("fraction"))
    # 2**20 cells of the fraction, in two levels of 2**10
    placed = placed.withColumn("cell", F.least(F.floor(F.col("fraction") * (1 << 20)), F.lit((1 << 20) - 1)).cast("int"))
    placed = common.written(placed.withColumn("top", F.shiftright("cell", 10)))
    fine = placed.groupBy("top", "cell").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("top").agg(F.sum("n").alias("n"))
    t = coarse.select("top", F.coalesce(F.sum("n").over(Window.orderBy("top").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("at_top"), F.sum("n").over(Window.partitionBy()).alias("total"))
    f = fine.select("top", "cell", F.coalesce(F.sum("n").over(_before("top", "cell")), zero).alias("at_cell")).join(t, "top").drop("top")
    order = Window.partitionBy("cell").orderBy("fraction", F.col("source").isNull(), "source", "h", "doc_id", "size", "text_crc32")
    out = placed.withColumn("in_cell", F.row_number().over(order)).join(f, "cell")
    position = F.col("at_top") + F.col("at_cell") + F.col("in_cell") - 1
    out = out.select("doc_id", "size", "text_crc32", "source", "fraction", position.alias("position"), "total")
    shard = F.expr(f"cast(position * {n_shards} div total as int)")
    out = out.withColumn("shard", shard)
    first = F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return out.withColumn("slot", (F.col("position") - first).cast("long")).drop("total")


def _hex_of_source(seed: str):
    return F.conv(F.substring(seed_hash(seed + " offset", F.col("source")), 1, 5), 16, 10).cast("double") / (1 << 20)
