"""Nearest neighbours by adaptive dimension scan over inverted lists.

A sample gives the centres of the lists and, by the true neighbours of some of its
rows, how many lists a query has to probe for RECALL of them. Vectors are rotated by a
seeded random orthogonal matrix, so that any block of COLUMNS rotated dimensions is a
fair part of a distance. Within a block of a probed list, candidates' partial distances
grow block of columns by block; a test at every step abandons those whose partial
distance is, by SIGMAS standard errors, too large for a place among the k nearest.
Those that remain are measured exactly in double precision on the original vectors.

A query first scans its own list, so that in all others it knows a bound on its k-th
distance: most candidates are then abandoned early and few rows are found. Lists are
split in blocks of base rows, which are shipped once; queries stream by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm import common, vectors

SAMPLE, LISTS, CALIBRATE = 8192, 1024, 256
#: Share of the calibrating queries' true neighbours that must be in probed lists; lists that are probed at least.
RECALL, PROBES = 0.97, 16
BLOCK, QUERIES, COLUMNS, SIGMAS = 2048, 128, 16, 2.1


@dataclass
class Index:
    centers: np.ndarray
    rotation: np.ndarray
    probes: int

    @property
    def dimensions(self) -> int:
        return self.centers.shape[1]


def fit(sample: np.ndarray, n: int, k: int, share: float = RECALL) -> Index:
    """share: of the calibrating queries' true neighbours (in the sample), those that must be in probed lists."""
    lists = max(1, min(LISTS, round(math.sqrt(n) / 2), len(sample)))
    c = vectors.centers(sample, lists)
    q = sample[np.random.default_rng(5).permutation(len(sample))[:CALIBRATE]]
    near = np.argsort(vectors.squares(q, sample), axis=1)[:, 1 : k + 1]  # the first is the query itself
    at = vectors.squares(sample, c).argmin(1)
    place = np.argsort(np.argsort(vectors.squares(q, c), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, at[near], 1).ravel())
    probes = int(ranks[max(0, math.ceil(share * len(ranks)) - 1)]) + 1 if len(ranks) else lists
    rotation, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((sample.shape[1],) * 2))
    return Index(c, rotation, min(lists, max(PROBES, probes)))


def exact(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows, summed in the order of the dimensions."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += (q[:, d] - b[:, d]) ** 2
    return np.sqrt(total)


def scan(index: Index, q: np.ndarray, q_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, position of the base row, distance) of each query's k nearest here, as far as the tests let them pass.

    known: a distance within which each query has k rows already. A query without one gets k
    rows at least, if there are as many others.
    """
    qr, br = q @ index.rotation, b @ index.rotation
    dims = q.shape[1]
    lengths = (q**2).sum(1), (b**2).sum(1)
    first = min(len(b), 8 * k)
    start = vectors.squares(q, b[:first])
    start[q_ids[:, None] == b_ids[None, :first]] = np.inf
    limit = np.sqrt(np.partition(start, k - 1, axis=1)[:, k - 1]) if first > k else np.full(len(q), np.inf)
    known = np.full(len(q), np.inf) if known is None else known
    limit = np.minimum(limit, known)
    slack = lambda i, j: 1e-12 * (1 + lengths[0][i] + lengths[1][j])  # noqa: E731  # of partial squares, which come from differences of lengths
    at = COLUMNS
    part = vectors.squares(qr[:, :at], br[:, :at])
    bound = lambda d: (limit * (1 + SIGMAS / math.sqrt(d)) * math.sqrt(d / dims)) ** 2
    pass_ = part <= bound(min(at, dims))[:, None] + slack(np.s_[:, None], np.s_[None])
    # of the first rows, those that set the limit stay
    safe = (start <= (limit[:, None] * (1 + 1e-9)) ** 2 + slack(np.s_[:, None], np.s_[None, :first])) & np.isinf(known)[:, None]
    pass_[:, :first] |= safe
    i, j = np.nonzero(pass_ & (q_ids[:, None] != b_ids[None]))
    part = part[i, j]
    while at < dims and len(i):
        part = part + ((qr[i, at : at + COLUMNS] - br[j, at : at + COLUMNS]) ** 2).sum(1)
        at += COLUMNS
        keep = part <= (bound(at)[i] if at < dims else (limit[i] * (1 + 1e-9)) ** 2) + slack(i, j)
        keep |= (j < first) & safe[i, np.minimum(j, first - 1)]
        i, j, part = i[keep], j[keep], part[keep]
    d = exact(q[i], b[j])
    order = np.lexsort((b_ids[j], d, i))
    i, j, d = i[order], j[order], d[order]
    start_of = np.searchsorted(i, i)
    top = np.arange(len(i)) - start_of < k
    return i[top], j[top], d[top]


_FOUND = "query_id long, vec_id long, score double"


def _nearest(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, length: int, n: int, k: int) -> DataFrame:
    """The k nearest of the asking ones of n rows (vec_id, embedding, asks) of one length, all of which take part."""
    sample = vectors.sample(rows, n, SAMPLE, "ann")
    index = fit(sample, n, k)
    kind = np.float64 if dict(rows.dtypes)["embedding"] == "array<double>" else np.float32

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors.read(batch.column("embedding"), index.dimensions)
            if len(at):
                asks = batch.column("asks").take(pa.array(at))
                d = vectors.squares(x.astype(np.float64), index.centers)
                own = pa.array(d.argmin(1), pa.int32())
                ask = np.flatnonzero(asks.fill_null(False).to_numpy(zero_copy_only=False))
                probes: list = [None] * len(at)
                for i, row in zip(ask.tolist(), np.argsort(d[ask], axis=1, kind="stable")[:, : index.probes], strict=True):
                    probes[i] = row
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), own, pa.array(probes, pa.list_(pa.int32())), vectors.bytes_of(x.astype(kind))], ["vec_id", "list", "probes", "x"])

    placed = common.written(rows.mapInArrow(assign, "vec_id long, list int, probes array<int>, x binary"))
    base = placed.select("vec_id", "list", "x")
    asking = placed.where("probes is not null")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, b = None, None
        for rows_, visitors in vectors.meetings(batches, ["list"], QUERIES):
            if rows_ is not seen:
                seen, b = rows_, vectors.matrix(rows_.column("x"), kind).astype(np.float64)
            b_ids, q_ids = rows_.column("vec_id").to_numpy(), visitors.column("vec_id").to_numpy()
            q = vectors.matrix(visitors.column("x"), kind).astype(np.float64)
            known = visitors.column("known").fill_null(np.inf).to_numpy(zero_copy_only=False)
            i, j, d = scan(index, q, q_ids, b, b_ids, k, known)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(b_ids[j]), pa.array(d)], ["query_id", "vec_id", "score"])

    width = 40 + length * np.dtype(kind).itemsize
    none = F.lit(None).cast("double").alias("known")
    home = asking.select("vec_id", "list", "x", none)
    first = common.written(_nearest(vectors.dealt(base, home, ["list"], BLOCK, width).mapInArrow(met, _FOUND), k))
    limits = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    other = asking.join(limits, "vec_id", "left").select("vec_id", F.explode(F.slice("probes", 2, index.probes)).alias("list"), "x", "known")
    rest = vectors.dealt(base, other, ["list"], BLOCK, width).mapInArrow(met, _FOUND)
    return _nearest(first.drop("rank").unionByName(rest), k)


def search(table: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest other rows of each row that `queries` selects.

    Nearness is the Euclidean distance in double precision; ties go to the smaller
    vec_id. Vectors that are null, empty, zero, or hold null or non-finite components take no
    part; those of different lengths aren't compared. Rows that share a vec_id are one
    vector, the smallest; rows without vec_id are left out. A query with fewer candidates
    returns all that it found. No rows: no rows. Other columns of table serve `queries` only.
    """
    asks = common.free(table, "asks")
    marked = table.where("embedding is not null and vec_id is not null").withColumn(asks, F.coalesce(queries, F.lit(False)))
    rows = vectors.one_row_each(marked, "embedding", asks).withColumnRenamed(asks, "asks").where(vectors.taking_part("embedding"))
    out = table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length, n in vectors.lengths(rows):
        if n > 1:
            out = out.unionByName(_of_length(rows.where(F.size("embedding") == length), length, n, k))
    return out
