"""Embedding near-dedup by product quantisation.

Exact copies (equal label and components) are first taken together, so a group of them
costs what one vector costs. Unit vectors have cosine >= t exactly when they are at most
r = sqrt(2 - 2t) apart.

* Coarse lists: each vector is in the list of its nearest centre and keeps the codes
  of its residual in SUBSPACES subspaces, with the length of what the codes leave out.
* Probes: a vector visits its PROBES nearest lists, or more: as many as a sample shows to
  hold the given share of vectors at cosine t from it. A pair is found where either of
  the two visits the other's list, and counts once.
* In a list, table lookups give its distance to every coded vector; less the length
  left out, that is a lower bound. What stays within r is reranked by exact cosine, so
  nothing below the threshold is linked and nothing in a visited list is missed.

Lists are split in blocks of base rows, which are shipped once; visitors stream by. A
task gives one row for each linked vector of a meeting: the number of its links and a
spanning tree's root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.llm import common, vectors
from glintframe.llm.components import components

SAMPLE, SUBSPACES, CODES = 8192, 8, 256
#: Vectors of one label that a list should hold; lists at most; rows of a block and of a chunk of visitors.
LIST_ROWS, LISTS, BLOCK, VISITORS = 256, 1024, 1024, 512
#: Lists that are visited at least; share of vectors at the least cosine whose list must be visited; vectors to calibrate with.
PROBES, RECALL, CALIBRATE = 8, 0.995, 2048


@dataclass
class Index:
    centers: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    probes: int

    @property
    def dimensions(self) -> int:
        return self.centers.shape[1]


def fit(sample: np.ndarray, lists: int, least: float) -> Index:
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    c = vectors.centers(x, min(lists, len(x)))
    rest = x - c[vectors.squares(x, c).argmin(1)]
    cuts = [round(i * x.shape[1] / SUBSPACES) for i in range(SUBSPACES + 1)]
    books = [vectors.centers(rest[:, a:b], min(CODES, len(x)), rounds=6) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Index(c, books, cuts, min(len(c), max(PROBES, probes_for(x, c, least))))


def probes_for(x: np.ndarray, centers: np.ndarray, least: float, share: float = RECALL) -> int:
    """How many nearest lists hold, for `share` of unit vectors x, a vector at cosine `least` in a random direction."""
    b = x[np.random.default_rng(5).permutation(len(x))[:CALIBRATE]]
    turn = np.random.default_rng(6).standard_normal(b.shape)
    turn -= (turn * b).sum(1, keepdims=True) * b
    norm = np.linalg.norm(turn, axis=1, keepdims=True)
    q = least * b + math.sqrt(1 - least**2) * turn / np.where(norm > 0, norm, 1)
    own = vectors.squares(b, centers).argmin(1)
    d = vectors.squares(q, centers)
    ranks = np.sort((d < d[np.arange(len(d)), own][:, None]).sum(1))
    return int(ranks[max(0, math.ceil(share * len(ranks)) - 1)]) + 1


def encode(index: Index, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: lists to visit, their own first; codes; and the length that the codes leave out."""
    visits = np.argsort(vectors.squares(unit, index.centers), axis=1, kind="stable")[:, : index.probes]
    rest = unit - index.centers[visits[:, 0]]
    codes = np.empty((len(unit), SUBSPACES), np.uint8)
    made = np.empty_like(rest)
    for m, (a, b) in enumerate(zip(index.cuts, index.cuts[1:], strict=False)):
        if a == b:
            codes[:, m] = 0
            continue
        codes[:, m] = vectors.squares(rest[:, a:b], index.books[m]).argmin(1)
        made[:, a:b] = index.books[m][codes[:, m]]
    return visits, codes, np.linalg.norm(rest - made, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_in_block(index: Index, cell: int, q: np.ndarray, q_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, codes: np.ndarray, left_out: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of q, of b) of pairs of different vectors whose exact cosine is at least `least`."""
    radius = math.sqrt(2 - 2 * least)
    rest = _unit(q) - index.centers[cell]
    d = np.zeros((len(q), len(b)))
    for m, (x, y) in enumerate(zip(index.cuts, index.cuts[1:], strict=False)):
        if x < y:
            d += vectors.squares(rest[:, x:y], index.books[m])[:, codes[:, m]]
    at_q, at_b = np.nonzero((d <= ((radius + 1e-6 + left_out) ** 2)[None]) & (q_ids[:, None] != b_ids[None]))
    keep = np.zeros(len(at_q), bool)
    qd, bd = q.astype(np.float64), b.astype(np.float64)
    qn, bn = np.sqrt((qd**2).sum(1)), np.sqrt((bd**2).sum(1))
    for at in range(0, len(at_q), 1 << 16):
        i, j = at_q[at : at + (1 << 16)], at_b[at : at + (1 << 16)]
        keep[at : at + (1 << 16)] = np.einsum("ij,ij->i", qd[i], bd[j]) / (qn[i] * bn[j]) >= least
    return at_q[keep], at_b[keep]


def roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each position reaches by links (i, j)."""
    root = ids.copy()
    while len(i):
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    return root


def _linked(vectors_: DataFrame, length: int, n: int, labels: int, least: float) -> DataFrame:
    """(vec_id, first, n_links, root) of linked vectors of one length of (vec_id, label, embedding), all of which take part: first is the smallest of its exact copies.

    A row's n_links and root are of one meeting; a vector's rows add up.
    """
    sample = vectors.sample(vectors_, n, SAMPLE, "pq")
    index = fit(sample, max(1, min(LISTS, round(n / max(labels, 1) / LIST_ROWS))), least)
    kind = np.float64 if dict(vectors_.dtypes)["embedding"] == "array<double>" else np.float32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = vectors.read(batch.column("embedding"), index.dimensions)
            if len(at):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), vectors.bytes_of(x.astype(kind))], ["vec_id", "label", "x"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                visits, codes, left_out = encode(index, _unit(vectors.matrix(batch.column("x"), kind)))
                more = [pa.array(list(visits), pa.list_(pa.int32())), vectors.bytes_of(codes), pa.array(left_out, pa.float64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "visits", "codes", "left_out"])

    packed = common.written(vectors_.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(pack, "vec_id long, label string, x binary"))
    one = packed.groupBy("label", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    coded = common.written(one.mapInArrow(assign, "label string, x binary, vec_id long, copies long, visits array<int>, codes binary, left_out double"))
    base = coded.withColumn("list", F.col("visits")[0])
    visiting = coded.select("vec_id", "label", "copies", F.col("visits")[0].alias("own"), F.explode("visits").alias("list"), "x")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for rows, visitors in vectors.meetings(batches, ["label", "list"], VISITORS):
            if rows is not seen:
                seen = rows
                b, codes = vectors.matrix(rows.column("x"), kind), vectors.matrix(rows.column("codes"), np.uint8)
                b_ids, left_out, b_copies = (rows.column(c).to_numpy() for c in ("vec_id", "left_out", "copies"))
                b_visits = rows.column("visits").flatten().to_numpy().reshape(len(rows), -1)
            q_ids, q_copies, own = (visitors.column(c).to_numpy() for c in ("vec_id", "copies", "own"))
            i, j = links_in_block(index, rows.column("list")[0].as_py(), vectors.matrix(visitors.column("x"), kind), q_ids, b, b_ids, codes, left_out, least)
            if not len(i):
                continue
            # where b doesn't visit q's list, it learns of the link here
            alone = ~(b_visits[j] == own[i][:, None]).any(1)
            n_q = np.bincount(i, b_copies[j], len(q_ids)).astype(np.int64)
            n_b = np.bincount(j[alone], q_copies[i[alone]], len(b_ids)).astype(np.int64)
            ids = np.concatenate([q_ids, b_ids])
            root = roots(ids, i, j + len(q_ids))
            touched = np.unique(np.concatenate([i, j + len(q_ids)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(np.concatenate([n_q, n_b])[touched]), pa.array(root[touched])], ["vec_id", "n", "root"])

    width = 80 + length * np.dtype(kind).itemsize
    found = common.written(vectors.dealt(base, visiting, ["label", "list"], BLOCK, width).mapInArrow(met, "vec_id long, n long, root long"))
    several = coded.where("copies > 1").select("label", "x", F.col("vec_id").alias("first"), "copies")
    copies = packed.join(several, ["label", "x"]).select("vec_id", "first", "copies")
    return found.select("vec_id", F.lit(None).cast("long").alias("first"), "n", "root").unionByName(copies.select("vec_id", "first", (F.col("copies") - 1).alias("n"), F.col("first").alias("root")))


def near_duplicates(table: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vec_id of (vec_id, embedding, label).

    Vectors link when their labels are equal and not null, their lengths are equal, and their
    cosine in double precision is at least `least` (over 0). Null, empty, zero and non-finite
    vectors have no links. Rows that share a vec_id are one vector, the smallest (label,
    embedding); rows without a vec_id are left out. No rows: no rows. Other columns of table
    play no part.
    """
    rows = vectors.one_row_each(table, "label", "embedding")
    known = rows.where(F.col("label").isNotNull() & vectors.taking_part("embedding"))
    labels = known.agg(F.approx_count_distinct("label")).first()[0]
    found = None
    for length, n in vectors.lengths(known):
        if n > 1:
            part = _linked(known.where(F.size("embedding") == length), length, n, labels, least)
            found = part if found is None else found.unionByName(part)
    ids = rows.select("vec_id")
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = common.written(found)
    groups = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"), F.max("first").alias("first"))
    # copies have the links of the first of them, besides each other
    of_first = links.where("first is null or first = vec_id").select(F.col("vec_id").alias("first"), F.col("n").alias("n_first"))
    counted = links.withColumn("first", F.coalesce("first", "vec_id")).join(of_first, "first").select("vec_id", F.col("n_first").alias("n_links"))
    out = ids.join(counted, "vec_id", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
