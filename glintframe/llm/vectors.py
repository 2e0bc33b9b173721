"""What the two vector operators share: reading, sampling and clustering of vectors, and meeting blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm import common


def read(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the vectors that take part: of that length, finite and not zero."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimensions)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)
    good = np.isfinite(x.astype(np.float64)).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def taking_part(column: str) -> Column:
    """Whether a vector takes part: neither null, empty nor zero, and all of it finite."""
    finite = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists(column, lambda c: c != 0), F.lit(False))


def lengths(rows: DataFrame) -> list[tuple[int, int]]:
    """(length, number) of the vectors of each length from 1, the most frequent first. Each length is indexed by itself."""
    size = F.size("embedding")
    found = rows.where(size > 0).groupBy(size.alias("length")).count().orderBy(F.desc("count"), "length").collect()
    return [(r["length"], r["count"]) for r in found]


def sample(vectors: DataFrame, n: int, size: int, seed: str) -> np.ndarray:
    """About `size` of n vectors of one length that take part, all if n is no more; fixed by a hash of vec_id."""
    rows = vectors.where(common.hashed_share(F.col("vec_id"), seed, min(1.0, size / max(n, 1)))).orderBy("vec_id").select("embedding").collect()
    x = np.array([[np.nan if v is None else v for v in r[0]] for r in rows], np.float64)
    return x[np.isfinite(x).all(1) & (x != 0).any(1)] if len(x) else np.empty((0, 0))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)


def centers(x: np.ndarray, k: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """k-means centres of a sample; an empty cluster keeps its centre."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = squares(x, c).argmin(1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=len(c))
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def one_row_each(vectors: DataFrame, *columns: str) -> DataFrame:
    """Rows of vec_id and columns, one for each vec_id: of several, the smallest. A null vec_id is left out."""
    whole = F.min(F.struct(*columns)).alias("row")
    return vectors.where("vec_id is not null").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(whole).select("vec_id", "row.*")


def dealt(base: DataFrame, visitors: DataFrame, keys: list[str], rows: int, bytes_each: int) -> DataFrame:
    """Base rows and visitors by (keys, block), a block's base rows first.

    A list of many base rows is split in blocks of about `rows`, and its visitors go to
    each. Base rows are shipped once. Both have the keys and a vec_id; columns of only one
    side are null on the other.
    """
    # at most one row a list
    blocks = common.written(base.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks")))
    split = F.pmod(F.xxhash64(F.lit("block"), F.col("vec_id")), F.col("blocks")).cast("int")
    left = base.join(blocks, keys).withColumn("block", split).withColumn("visits_block", F.lit(False))
    right = visitors.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("visits_block", F.lit(True))
    both = left.drop("blocks").unionByName(right.drop("blocks"), allowMissingColumns=True)
    n, copies = base.count(), right.count()
    parts = common.pieces(base.sparkSession, (n + copies) * bytes_each, 16 << 20)
    order = [*keys, "block"]
    return both.repartition(parts, *order).sortWithinPartitions(*order, "visits_block")


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch]]:
    """(base rows, up to `most` visitors) of each block of dealt rows; a block's base rows and one batch are held."""
    order = [*keys, "block"]
    now, held, base = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        changed[0] = True
        for c in [*order, "visits_block"]:
            column = batch.column(c)
            changed[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(batch) - 1)).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(changed).tolist()
        for a, b in zip(start, [*start[1:], len(batch)], strict=True):
            part = batch.slice(a, b - a)
            key = tuple(part.column(c)[0].as_py() for c in order)
            if key != now:
                now, held, base = key, [], None
            if not part.column("visits_block")[0].as_py():
                held.append(part)
                continue
            if base is None:
                table = pa.Table.from_batches(held, schema=batch.schema).combine_chunks()
                base = table.to_batches()[0] if len(table) else None
                held = []
            for at in range(0, len(part), most) if base is not None else ():
                yield base, part.slice(at, most)


def bytes_of(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())
