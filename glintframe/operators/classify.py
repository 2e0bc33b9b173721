"""Zero-shot classification of vectors against a two-level taxonomy of prompt vectors.

A taxonomy is mostly a small dimension (about a thousand prompts): up to BLOCK prompts are
broadcast, and vectors are neither exploded nor shuffled. Of more prompts none is collected:
blocks of vectors meet blocks of prompts, each pair in one matrix product, and the best of each
category are compared once more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.sources.tables import shared_folder

#: Prompts of a block, and vectors of a block where there are several.
BLOCK, ROWS = 20_000, 20_000
#: Softmax factor, least probability and number of tags kept.
SCALE, LEAST, TOP = 100.0, 0.02, 5

_BEST = "vec_id long, cat_idx int, sub_idx long, sim double"
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("cat_idx", pa.int32()), ("sub_idx", pa.int64()), ("sim", pa.float64())])


def _rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, matrix, norms) of the arrays that are not null; null components count as 0.

    Short arrays are filled with zeros up to the width and long ones cut, which leaves every dot
    product one over the shorter length; norms are of whole arrays.
    """
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    known = column.take(pa.array(at))
    lengths = known.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = known.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(at)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    norms = np.sqrt(np.bincount(row, flat * flat, len(at)))
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(at), width))
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return at, out, norms


class Prompts:
    """A block of prompts (cat_idx, sub_idx, v), ready for products; in order of (cat_idx, sub_idx)."""

    def __init__(self, block: pa.Table) -> None:
        block = block.sort_by([("cat_idx", "ascending"), ("sub_idx", "ascending")])
        at, prompts, size = _rows(block.column("v").combine_chunks())
        cats = block.column("cat_idx").to_numpy()[at].astype(np.int32)
        self.subs = block.column("sub_idx").to_numpy()[at].astype(np.int64)
        self.names, first = np.unique(cats, return_index=True)
        self.spans = list(zip(first, [*first[1:], len(cats)], strict=True))
        self.vectors = (prompts / np.where(size > 0, size, 1)[:, None]).T

    def best(self, ids: pa.Array, vectors: pa.Array) -> Iterator[pa.RecordBatch]:
        """The best prompt of each category for each vector that is not null."""
        for start in range(0, len(ids), 1024):
            rows, v, n = _rows(vectors.slice(start, 1024), len(self.vectors))
            sims = (v / np.where(n > 0, n, 1)[:, None]) @ self.vectors
            best = np.stack([a + sims[:, a:b].argmax(1) for a, b in self.spans], 1)
            k = len(self.names)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, 1024).take(pa.array(np.repeat(rows, k))).cast(pa.int64()), pa.array(np.tile(self.names, len(rows))), pa.array(self.subs[best].ravel()), pa.array(np.take_along_axis(sims, best, 1).ravel())],
                ["vec_id", "cat_idx", "sub_idx", "sim"],
            )


def _by_all(vectors: DataFrame, prompts: pa.Table) -> DataFrame:
    """Prompts that fit in one block: broadcast, so that vectors don't move."""
    sent = vectors.sparkSession.sparkContext.broadcast(prompts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Prompts(sent.value)
        for batch in batches:
            yield from ready.best(batch.column("vec_id"), batch.column("v"))

    return vectors.select("vec_id", "v").mapInArrow(score, _BEST)


def _by_blocks(vectors: DataFrame, taxonomy: DataFrame, n: int, block: int, rows: int) -> DataFrame:
    """More prompts: blocks of about `rows` vectors by blocks of about `block` prompts, each pair one group; the best of a category are merged."""
    spark = vectors.sparkSession
    down, across = max(1, -(-vectors.count() // rows)), -(-n // block)
    home = f"{shared_folder(spark)}/classify-{uuid.uuid4().hex}"
    # dealt out in turn and kept, as a vec_id may repeat without bound
    vectors.select("vec_id", "v").repartition(down).withColumn("row", F.spark_partition_id() % down).write.parquet(home)
    left = spark.read.parquet(home).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = taxonomy.withColumn("column", F.pmod(F.xxhash64("cat_idx", "sub_idx"), F.lit(across)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))

    def score(own: pa.Table, prompts: pa.Table) -> pa.Table:
        found = []
        if len(own) and len(prompts):
            ready, own = Prompts(prompts), own.combine_chunks()
            for batch in own.to_batches():
                found += ready.best(batch.column("vec_id"), batch.column("v"))
        return pa.Table.from_batches(found, schema=_SCHEMA)

    pairs = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(score, _BEST)
    best = F.max_by(F.struct("sub_idx", "sim"), F.struct("sim", -F.col("sub_idx")))
    return pairs.groupBy("vec_id", "cat_idx").agg(best.alias("b")).select("vec_id", "cat_idx", "b.sub_idx", "b.sim")


def best_prompts(vectors: DataFrame, taxonomy: DataFrame, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """(vec_id, cat_idx, sub_idx, sim): of each category the most similar prompt, the first on ties.

    vectors: (vec_id, v); taxonomy: (cat_idx, sub_idx, v). A dot product runs over the shorter of
    two lengths, norms over whole vectors; a zero norm gives similarity 0. A null vector gives
    no row, a null prompt or category takes no part, a null component counts as 0. Without
    prompts: no rows. Rows that share a vec_id count as one where there are several blocks.
    """
    known = taxonomy.select("cat_idx", "sub_idx", "v").where("v is not null and cat_idx is not null")
    few = known.limit(block + 1).toArrow()
    if not len(few):
        return vectors.select("vec_id", F.lit(0).alias("cat_idx"), F.lit(0).cast("long").alias("sub_idx"), F.lit(0.0).alias("sim")).limit(0)
    return _by_all(vectors, few) if len(few) <= block else _by_blocks(vectors, known, known.count(), block, rows)


def softmax(best: DataFrame, scale: float = SCALE) -> DataFrame:
    """best with `prob` over the categories of each vector."""
    one = Window.partitionBy("vec_id")
    weight = F.exp(F.col("sim") * scale - F.max(F.col("sim") * scale).over(one))
    return best.withColumn("weight", weight).withColumn("prob", F.col("weight") / F.sum("weight").over(one)).drop("weight")


def top_tags(scored: DataFrame, least: float = LEAST, top: int = TOP) -> DataFrame:
    """The tags of at least `least`, best first, at most `top` for each vector; the first category wins ties."""
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("prob"), "cat_idx"))
    return scored.where(F.col("prob") >= least).withColumn("rank", rank).where(F.col("rank") <= top)
