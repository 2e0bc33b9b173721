"""Quality classifier: votes of the nearest labelled texts in a latent semantic space.

Terms are trigrams of character kinds (16 kinds: lower, upper, digit, space, line
feed and groups of signs), which tell style, and lower-cased words hashed to WORDS
terms, which tell content. Terms are weighted by log count and inverse document
frequency; a truncated singular value decomposition of a bounded sample gives
latent axes. Labelled sample vectors are broadcast. Every document's cosine with all
of them is computed exactly, block by block, and its nearest NEIGHBOURS vote with
their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common, tokens

#: Expected labelled sample rows, latent axes, voting neighbours, terms of words.
SAMPLE, AXES, NEIGHBOURS, WORDS = 4000, 48, 25, 4096
BLOCK = 256
_KIND = np.full(256, 15, np.uint8)  # bytes of other than ASCII characters count as lower-case letters
for _k, _group in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",;:", "!", "?", "|", "$%&*#", "'\"`", "()[]{}<>", "/\\@_=+~^", "-")):
    _KIND[list(_group.encode())] = _k
_KIND[128:] = 0
STYLES = 16**3


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequencies of the terms
    axes: np.ndarray  # terms x latent axes
    vectors: np.ndarray  # labelled unit vectors
    labels: np.ndarray
    prior: float


def counts(text: str | None) -> np.ndarray:
    """Counts of the terms of a whole text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(STYLES + WORDS, np.float32)
    for at in range(0, max(0, len(raw) - 2), tokens.SLICE):
        k = _KIND[raw[at : at + tokens.SLICE + 2]].astype(np.int64)
        out[:STYLES] += np.bincount((k[:-2] << 8) | (k[1:-1] << 4) | k[2:], minlength=STYLES)
    if len(raw):
        hashes, _ = tokens.words(raw, np.array([0, len(raw)]), lower=True)
        out[STYLES:] += np.bincount((hashes % tokens.U(WORDS)).astype(np.int64), minlength=WORDS)
    return out


def latent(terms: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of counts; a text without terms stays zero. Style and words have equal norms."""
    x = np.log1p(terms) * weights
    for part in (x[:, :STYLES], x[:, STYLES:]):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part /= np.where(norm > 0, norm, 1)
    y = x @ axes
    norm = np.linalg.norm(y, axis=1, keepdims=True)
    return y / np.where(norm > 0, norm, 1)


def fit_rows(terms: list[tuple[np.ndarray, np.ndarray]], labels: list[int], axes: int = AXES, seed: int = 7) -> Model:
    """A model of sample rows, each (numbers of its terms, counts); without rows, every text gets 0.5."""
    y = np.array(labels, np.float32)
    if not len(y):
        return Model(np.ones(STYLES + WORDS, np.float32), np.zeros((STYLES + WORDS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.zeros((len(y), STYLES + WORDS), np.float32)  # changed in place, as the driver holds it
    for row, (at, count) in zip(x, terms, strict=True):
        row[at] = count
    weights = np.log((1 + len(y)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + np.float32(0.1)
    np.log1p(x, out=x)
    x *= weights
    for part in (x[:, :STYLES], x[:, STYLES:]):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part /= np.where(norm > 0, norm, 1)
    k = min(axes, len(y))
    q = np.random.default_rng(seed).standard_normal((x.shape[1], k + 10)).astype(np.float32)
    for _ in range(4):  # randomized subspace iteration for the leading singular vectors
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, right = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ right.T)[:, :k].astype(np.float32)
    v = x @ basis
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return Model(weights, basis, (v / np.where(norm > 0, norm, 1)).astype(np.float32), y, float(y.mean()))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of (doc_id, text, quality): about `sample` rows, fixed by a hash of doc_id.

    Executors count the terms; a row's terms and counts (at most 48 KB, whatever the text's
    length) reach the driver. Rows whose label or doc_id is null are left out. Of rows that
    share a doc_id one votes: that of the smallest (text, label).
    """
    known = labelled.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    n = known.agg(F.approx_count_distinct("doc_id", 0.01)).first()[0]
    few = known.where(common.hashed_share(F.col("doc_id"), "quality", min(1.0, sample / max(n, 1))))
    one = few.groupBy("doc_id").agg(F.min(F.struct("text", "quality")).alias("r")).select("doc_id", F.col("r.text").alias("text"), F.col("r.quality").cast("double").alias("quality"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t.as_py()) for t in common.text_column(batch, "text")]
            at = [np.flatnonzero(x) for x in found]
            columns = [pa.array([i.astype(np.int32).tobytes() for i in at], pa.binary()), pa.array([x[i].tobytes() for x, i in zip(found, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *columns], ["doc_id", "quality", "at", "count"])

    rows = one.mapInArrow(common.tidy(count), common.schema_with(one.select("doc_id", "quality"), at=T.BinaryType(), count=T.BinaryType())).orderBy("doc_id").toArrow()
    terms = [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(c.as_py(), np.float32)) for a, c in zip(rows.column("at"), rows.column("count"), strict=True)]
    return fit_rows(terms, [int(v > 0) for v in rows.column("quality").to_pylist()])


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs' text for a bounded sample of labelled documents; labels: (doc_id, quality).

    The labels are sampled by a hash of doc_id first, and of several for a doc_id the smallest
    counts, so the broadcast side has about `sample` rows.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    share = min(1.0, sample / max(known.agg(F.approx_count_distinct("doc_id", 0.01)).first()[0], 1))
    few = known.where(common.hashed_share(F.col("doc_id"), "quality", share)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def votes(y: np.ndarray, model: Model, neighbours: int) -> np.ndarray:
    """Scores of unit vectors: the prior counts as one neighbour of similarity 0.1.

    Of equally near labelled rows the first in the sample's order, that of doc_id, vote.
    """
    if not len(model.labels):
        return np.full(len(y), model.prior)
    near = y @ model.vectors.T
    k = min(neighbours, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    row, at = np.nonzero(near >= least)
    value = near[row, at]
    order = np.lexsort((at, -value, row))
    row, at, value = row[order], at[order], value[order]
    chosen = np.arange(len(row)) - np.searchsorted(row, row) < k
    row, at = row[chosen], at[chosen]
    weight = np.maximum(value[chosen], 0).astype(np.float64) ** 4
    total = np.bincount(row, weight, len(y)) + 0.1
    return (np.bincount(row, weight * model.labels[at], len(y)) + model.prior * 0.1) / total


def score(docs: DataFrame, model: Model, threshold: float = 0.3, neighbours: int = NEIGHBOURS) -> DataFrame:
    """docs with `score` (0 to 1, higher: label 1 likelier) and `predicted` (1 if score >= threshold).

    A null or empty text has no terms and gets the share of label 1 in the sample. Equal texts
    get equal scores. Other columns pass through; those named like the new two are replaced.
    """
    rest = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                terms = np.stack([counts(t) for t in common.text_column(part, "text").to_pylist()])
                s = np.clip(votes(latent(terms, m.weights, m.axes), m, neighbours), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*part.schema.names, "score", "predicted"])

    return rest.mapInArrow(common.tidy(apply), common.schema_with(rest, score=T.DoubleType(), predicted=T.IntegerType()))
