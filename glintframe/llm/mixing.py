"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Targets are water-filled in closed form: a source is full once the common level
passes 3 * size / weight, so sorted by that ratio prefix sums give the level.
Each document expects target / source_size copies. Prefix sums of the expected
copies along a fixed order are rank * expectation; one random offset for each
source is added, and a document is emitted once for each integer boundary that its
stretch crosses.

Documents are ordered by size, so that what is taken follows the target closely.
Ranks come from counts of cells: (source, size band) and (source, band, salt of
the doc_id). A window task holds the rows of one cell, or at most 256 counts, so a
source with most of the rows does not meet in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm import common

SALTS = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def seed_hash(seed: str, *keys: Column) -> Column:
    """32 hexadecimal digits that stand for the keys; DuckDB's md5 gives the same."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys)))


def order_hash(seed: str) -> Column:
    """Orders documents by doc_id; those without one by their text, so that they don't meet in one place."""
    return seed_hash(seed, F.when(F.col("doc_id").isNull(), F.concat(F.lit("null"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))).otherwise(F.col("doc_id").cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, n) to target: shares of the whole size by weight, at most cap times a source's own size.

    One row a source meets in one task here; these are sums, not documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    weighed = sizes.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(cap))
    by = Window.orderBy(full / F.col("weight"), F.col("source").isNull(), "source")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = weighed.select(
        "*",
        full.alias("full"),
        # the level if all sources before this one in the order are full and no other
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(after)).alias("level"),
    )
    # the first source that its level does not fill sets the level
    chosen = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return level.select("source", "source_size", "n", F.least(F.coalesce(chosen * F.col("weight"), F.col("full")), F.col("full")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, row key, size, source_size, target, copies) of every document.

    Sources stand in code point order, null last, with the weights in turn. A null
    text has size 0; equal rows are ranked one by one. Reruns give the same copies for
    each doc_id (rows that share a doc_id and size may swap theirs). An empty table
    gives no rows. Columns of docs other than doc_id, text and source play no part.
    """
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), order_hash(seed).alias("h"))
    rows = rows.withColumn("band", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"))
    rows = common.written(rows.withColumn("salt", F.conv(F.substring("h", 1, 2), 16, 10).cast("int")))
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    cells = rows.groupBy("source", "band", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bands = cells.groupBy("source", "band").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = bands.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n"))
    goal = targets(sums, weights, cap).drop("n").withColumn("offset", F.conv(F.substring(seed_hash(seed + " offset", F.col("source")), 1, 5), 16, 10).cast("double") / (1 << 20))
    b = bands.select("source", "band", F.coalesce(F.sum("n").over(earlier("source", "band")), F.lit(0)).alias("band_at"))
    b = b.join(goal, same(b, goal, ["source"])).drop(goal["source"])
    c = cells.select("source", "band", "salt", F.coalesce(F.sum("n").over(earlier("source", "band", "salt")), F.lit(0)).alias("cell_at"))
    c = c.join(b, same(c, b, ["source", "band"])).drop(b["source"]).drop(b["band"])
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "band", "salt").orderBy("h", "doc_id", "size")))
    r = ranked.join(c, same(ranked, c, ["source", "band", "salt"])).drop(c["source"]).drop(c["band"]).drop(c["salt"])
    expects = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rank * expects + F.col("offset"))
    at = F.col("band_at") + F.col("cell_at") + F.col("rank")
    return r.select("doc_id", "source", "h", "rank", "size", "source_size", "target", (upto(at) - upto(at - 1)).cast("long").alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of docs, each as often as it is taken; those taken no time are left out.

    Rows with the same doc_id, source and size share out the copies planned for them; rows
    without a doc_id stand by their text. Columns of docs pass through, whatever their names.
    """
    row, nth, copy = (common.free(docs, c) for c in ("row", "nth", "copy"))
    most = math.ceil(cap) + 1
    times = [f"times_{k}" for k in range(1, most + 1)]
    plan = mixed(docs, weights, cap, seed)
    key = lambda h, source, size: seed_hash("row", h, source, size)
    # of the rows with one key, how many are taken at least k times
    plan = plan.groupBy(key(F.col("h"), F.col("source"), F.col("size")).alias(row)).agg(*(F.count_if(F.col("copies") >= k).alias(c) for k, c in enumerate(times, 1))).where("times_1 > 0")
    plan = plan.select(F.col(row), F.array(*times).alias(copy))
    own = docs.withColumn(row, key(order_hash(seed), F.col("source").cast("string"), n_words(F.col("text"))))
    taken = own.join(plan, row).withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    each = F.filter(F.col(copy), lambda n: n >= F.col(nth))
    return taken.withColumn(copy, F.explode(each)).select(*docs.columns)
