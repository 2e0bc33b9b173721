"""Whitening of embeddings by principal components.

Vectors are rounded to whole 64ths, as long. Each distinct one stands once in the fit list,
which Spark's distinct makes (copies are combined before the shuffle). Sums over the list are
exact, so its rows are centred exactly: (n * x - sum) is a whole number and is divided by n
only then. MLlib's RowMatrix adds up the Gramian of the centred rows in a tree of partial
sums; Gramian / n is the covariance. The driver solves the one dimensions x dimensions
eigenproblem, and the whitening goes as a broadcast to mapInPandas over all rows.

Of the corpus the driver gets two matrices of dimensions x dimensions and one row of sums a
dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm import common

#: Steps of one unit; an entry c becomes floor(STEPS * c). A constant added to all entries, such as 1,000,000, changes no result, as n * x - sum is the same.
STEPS = 64
#: Entries as large as this have no place in 64 bits; their vectors are dropped like those with non-finite ones.
LIMIT = float(1 << 55)
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]  # of the fit list, by dimension
    exact: bool  # n * x - sum and the squares' sum fit in 64 bits
    vectors: np.ndarray  # dimensions x components, over the roots of their eigenvalues
    rank: int  # components whose eigenvalue is more than rounding; the others have no whitened value
    explained: list[float]


def whole(column: Column) -> Column:
    """Entries as whole steps."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * float(STEPS)))


def placed(table: DataFrame, dimensions: int | None) -> tuple[DataFrame, int]:
    """(vec_id as string, x) of the rows that take part, and their dimensions: those of most rows, the longer of two as frequent."""
    good = table.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LIMIT)))
    if dimensions is None:
        size = F.size("embedding")
        most = good.where(size > 0).groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        dimensions = most["size"] if most else 0
    rows = good.where(F.size("embedding") == dimensions)
    return rows.select(F.col("vec_id").cast("string").alias("vec_id"), whole(F.col("embedding")).alias("x")), dimensions


def sums(fit_list: DataFrame) -> tuple[int, list[int], int]:
    """Rows, exact sums by dimension and the largest absolute entry. A task sends one row a dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, most = 0, 0, 0, 0
        for batch in batches:
            if len(batch):
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
                n, most = n + len(x), max(most, int(np.abs(x).max()))
                high, low = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)  # halves, so that no sum overflows
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d), pa.array(high), pa.array(low), pa.array([most] * d)], ["d", "n", "high", "low", "most"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    each = fit_list.mapInArrow(partial, "d int, n long, high long, low long, most long").groupBy("d").agg(F.sum("n").alias("n"), wide("high"), wide("low"), F.max("most").alias("most"))
    found = each.orderBy("d").collect()  # one row a dimension
    return found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found], max(r["most"] for r in found)


def gramian(rows: DataFrame, n: int, dimensions: int) -> np.ndarray:
    """Sum of the outer products of the rows of the one array column `row`."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("row").alias("row")), "row")
    return RowMatrix(vectors, n, dimensions).computeGramianMatrix().toArray()


def fit(fit_list: DataFrame, components: int) -> Whitening:
    n, total, most = sums(fit_list)
    d = len(total)
    exact = d * (2 * n * max(most, 1)) ** 2 <= LONGEST
    kind = "long" if exact else "decimal(38,0)"
    each = F.lit(n).cast(kind)
    constant = F.array(*(F.lit(str(t)).cast(kind) for t in total))
    centred = F.zip_with("x", constant, lambda x, t: (x.cast(kind) * each - t).cast("double") / n)
    covariance = gramian(fit_list.select(centred.alias("row")), n, d) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    rank = int((values > max(values[0], 0) * d * 8 * np.finfo(float).eps).sum())
    scaled = np.where(np.arange(len(values)) < rank, vectors / np.sqrt(np.where(values > 0, values, 1)), 0.0)
    trace = float(np.trace(covariance))
    return Whitening(n, total, exact, scaled, rank, [max(float(v), 0.0) / trace if trace > 0 else 0.0 for v in values])


def projected(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and z, the whitened vector, of rows of vec_id and x; those without a component have 0 in it."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        total = np.array(m.sums, np.int64 if m.exact else object)
        for f in frames:
            if len(f):
                off = np.stack(f["x"].to_numpy()).astype(total.dtype) * m.n - total
                far = (off * off).sum(1)
                z = (off.astype(np.float64) / m.n) @ m.vectors
                yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": [str(v) if v <= LONGEST else None for v in far], "z": list(z)})

    return rows.mapInPandas(project, "vec_id string, deviation string, z array<double>")


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, over the components that there are."""
    k = len(model.explained)
    z = projected(fit_list.select(F.lit(None).cast("string").alias("vec_id"), "x"), model).select("z")
    vectors = MLUtils.convertVectorColumnsFromML(z.select(array_to_vector("z").alias("z")), "z")
    mean = F.array(*(F.lit(float(v)) for v in RowMatrix(vectors, model.n, k).computeColumnSummaryStatistics().mean()))
    covariance = gramian(z.select(F.zip_with("z", mean, lambda a, b: a - b).alias("row")), model.n, k) / model.n
    off = np.abs(covariance - np.eye(k))[: model.rank, : model.rank]
    return float(off.max()) if off.size else 0.0


def whitened(table: DataFrame, components: int = 16, dimensions: int | None = None) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each row and component.

    A vector that is null, holds null or non-finite entries or entries from 2^55 on is dropped,
    and so is one of other dimensions than most rows (or than `dimensions`) have. Equal vectors
    count once in the fit list and each have their rows in the result, as have rows that share a
    vec_id or have none. A component without variance (all vectors equal, fewer distinct vectors
    than components) has a null whitened value, explained 0, and no part in identity_error. A
    deviation beyond 64 bits is null. No vectors: no rows. Other columns of table play no part.
    """
    kind = table.schema["vec_id"].dataType
    rows, d = placed(table, dimensions)
    if d:
        fit_list = common.written(rows.select("x").distinct())
        if fit_list.isEmpty():
            d = 0
    if not d:
        return rows.select(F.col("vec_id").cast(kind).alias("vec_id"), *(F.lit(None).cast(t).alias(c) for c, t in _MORE.items())).where("false")
    model = fit(fit_list, min(components, d))
    error = identity_error(fit_list, model)
    flat = projected(rows, model).select("vec_id", "deviation", F.posexplode("z").alias("at", "value"))
    return flat.select(
        F.col("vec_id").cast(kind).alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        F.when(F.col("at") < model.rank, F.col("value")).alias("whitened"),
        F.get(F.array(*(F.lit(v) for v in model.explained)), F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


_MORE = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
