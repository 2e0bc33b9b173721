"""Neural models as plug-in scorers: a registry of factories, opened once in each worker, fed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glintframe.operators.pixels import PREPS, tensors_of
from glintframe.sources.images import as_text, from_text


class Scorer(Protocol):
    """What a model offers: rows out for a batch of blobs. `schema` names its columns besides the key."""

    schema: str

    def score(self, content: pd.Series) -> list[list[tuple]]: ...


class BatchScorer(Protocol):
    """A model over tensors: n x 3 x height x width of float32, of which the first widths[i] columns are the i-th's own; rows out for each."""

    schema: str

    def score_batch(self, x: np.ndarray, widths: list[int]) -> list[list[tuple]]: ...


_FACTORIES: dict[str, Callable[[], Scorer]] = {}
_open: dict[str, Scorer] = {}


def register(name: str, factory: Callable[[], Scorer]) -> None:
    _FACTORIES[name] = factory


def run(blobs: DataFrame, name: str, key: str = "path", content: str = "content") -> DataFrame:
    """Every row that the model `name` gives for each blob, with the blob's key."""
    if name not in _FACTORIES:
        raise KeyError(f"unknown model {name}; known: {', '.join(sorted(_FACTORIES))}")
    factory = _FACTORIES[name]
    schema = factory().schema
    names = [part.split()[0] for part in schema.split(",")]
    kind = dict(blobs.dtypes)[key]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _open.setdefault(name, factory())
        for pdf in batches:
            rows = [(k, *r) for k, found in zip(pdf[key], model.score(pdf[content]), strict=True) for r in found]
            yield pd.DataFrame(rows, columns=[key, *names])

    return blobs.select(key, content).mapInPandas(score, f"{key} {kind}, {schema}")


def routed(blobs: DataFrame, default: str) -> DataFrame:
    """(path, model, and the models' columns) of blobs (path, content, model): each by the model that it names, else by the default.

    The models offered must have one schema. A batch is split by model, so each is called once for a batch.
    """
    known = dict(_FACTORIES)
    schema = known[default]().schema
    same = [n for n, f in known.items() if f().schema == schema]
    names = [part.split()[0] for part in schema.split(",")]
    asked = F.when(F.col("model").isin(same), F.col("model")).otherwise(default)
    kind = dict(blobs.dtypes)["path"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, part in pdf.groupby("model"):
                model = _open.setdefault(name, known[name]())
                rows = [(k, name, *r) for k, found in zip(part["path"], model.score(part["content"]), strict=True) for r in found]
                yield pd.DataFrame(rows, columns=["path", "model", *names])

    return blobs.select("path", "content", asked.alias("model")).mapInPandas(score, f"path {kind}, model string, {schema}")


def by_image(crops: DataFrame, name: str) -> DataFrame:
    """(image_id, box_id, and the model's columns) of crops (image_id, box_id, pixels): one call an image, rows filled with zeros to the widest; null pixels are none."""
    factory = _FACTORIES[name]
    schema = factory().schema
    names = [part.split()[0] for part in schema.split(",")]
    listed = crops.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "pixels"))).alias("crops"))
    listed = listed.select("image_id", F.transform("crops", lambda c: c["box_id"]).alias("box_id"), F.transform("crops", lambda c: c["pixels"]).alias("pixels"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _open.setdefault(name, factory())
        for pdf in batches:
            rows = []
            for image, boxes, pixels in zip(pdf["image_id"], pdf["box_id"], pdf["pixels"], strict=True):
                pixels = [() if p is None else p for p in pixels]
                wide = np.zeros((len(pixels), max(map(len, pixels))))
                for row, p in zip(wide, pixels, strict=True):
                    row[: len(p)] = p
                rows += [(image, box, *r) for box, r in zip(boxes, model.score(wide), strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "box_id", *names])

    return listed.mapInPandas(score, f"image_id long, box_id int, {schema}")


#: Bytes of tensors that a task holds before it calls the model, about, and most tensors of a call.
HELD, BATCH = 16 << 20, 32


def width_of(width: int, step: int = 64) -> int:
    """The width that a tensor is filled up to: a multiple of step, so that few widths are left."""
    return -(-width // step) * step


def packs(shapes: list[tuple[int, int]], batch: int, step: int) -> list[list[int]]:
    """Positions that go into one call each: tensors of one height and one filled-up width, in their order, at most `batch`."""
    buckets: dict[tuple[int, int], list[int]] = {}
    for i, (width, height) in enumerate(shapes):
        buckets.setdefault((height, width_of(width, step)), []).append(i)
    return [b[at : at + batch] for b in buckets.values() for at in range(0, len(b), batch)]


def batched(tensors: DataFrame, name: str, key: str = "path", batch: int = BATCH, step: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """key and the model's columns of tensors (key, width, height, tensor: three channels of float32), many of them in a call, whatever picture they are of.

    A task holds about HELD bytes of tensors. Those of one height whose widths fill up to the same
    multiple of `step` go in calls of at most `batch`, filled with zeros; n tensors of b such
    sizes take at most n / batch + b calls. Rows come in the order of the tensors. A null tensor
    gives no rows. profile: resources that the stage asks for, as a GPU.
    """
    columns, scored = _calls(name, batch, step)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        yield from scored((k, np.frombuffer(t, np.float32).reshape(3, h, w)) for k, w, h, t in rows)

    kind = tensors.schema[key].dataType
    rows = tensors.where("tensor is not null").select(as_text(F.col(key), kind).alias("key"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "tensor")
    out = rows.mapInPandas(run, f"key string, {columns}", profile=profile)
    return out.select(from_text(F.col("key"), kind).alias(key), *out.columns[1:])


def _calls(name: str, batch: int, step: int) -> tuple[str, Callable[[Iterable[tuple[str, np.ndarray]]], Iterator[pd.DataFrame]]]:
    """The model's columns, and what gives its rows for (key, tensor) in their order."""
    if name not in _FACTORIES:
        raise KeyError(f"unknown model {name}; known: {', '.join(sorted(_FACTORIES))}")
    factory = _FACTORIES[name]
    schema = factory().schema
    names = ["key", *(part.split()[0] for part in schema.split(","))]

    def called(model: BatchScorer, held: list[tuple[str, np.ndarray]]) -> pd.DataFrame:
        found: list[list[tuple]] = [[]] * len(held)
        for pack in packs([(t.shape[2], t.shape[1]) for _, t in held], batch, step):
            first = held[pack[0]][1]
            wide = np.zeros((len(pack), 3, first.shape[1], width_of(first.shape[2], step)), np.float32)
            for row, i in zip(wide, pack, strict=True):
                row[:, :, : held[i][1].shape[2]] = held[i][1]
            for i, rows in zip(pack, model.score_batch(wide, [held[i][1].shape[2] for i in pack]), strict=True):
                found[i] = rows
        return pd.DataFrame([(k, *r) for (k, _), rows in zip(held, found, strict=True) for r in rows], columns=names)

    def scored(tensors: Iterable[tuple[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
        model = _open.setdefault(name, factory())
        held: list[tuple[str, np.ndarray]] = []
        total = 0
        for key, t in tensors:
            held.append((key, t))
            total += t.nbytes
            if total >= HELD:
                yield called(model, held)
                held, total = [], 0
        if held:
            yield called(model, held)

    return schema, scored


def scored(pictures: DataFrame, prep: str, name: str, key: str = "path", batch: int = BATCH, step: int = 64, profile: ResourceProfile | None = None) -> DataFrame:
    """batched(prepared(pictures, prep, key), name, key) in one pass: a tensor is made and scored in the same task and never moves as a row."""
    columns, calls = _calls(name, batch, step)
    ready, kind = PREPS[prep], pictures.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in calls((k, t) for k, _, t in tensors_of(batches, ready) if t is not None):
            yield pa.RecordBatch.from_pandas(pdf, arrow, preserve_index=False)

    rows = pictures.where("pixels is not null").select(as_text(F.col(key), kind).alias("key"), "width", "height", "pixels")
    schema = T.StructType().add("key", "string")
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(columns).fields])
    arrow = to_arrow_schema(schema)
    out = rows.mapInArrow(run, schema, profile=profile)
    return out.select(from_text(F.col("key"), kind).alias(key), *out.columns[1:])


class Linear:
    """A model without training: weighted sums of a tensor, the weights by a rule from channel, row, column and output; filled-up columns add nothing."""

    def __init__(self, outputs: int = 2) -> None:
        self.outputs, self.schema = outputs, ", ".join(f"y{o} double" for o in range(outputs))

    def score_batch(self, x: np.ndarray, widths: list[int]) -> list[list[tuple]]:
        o, c, h, w = np.ogrid[: self.outputs, : x.shape[1], : x.shape[2], : x.shape[3]]
        weights = ((c * 31 + h * 17 + w * 7 + o * 13) % 29 - 14) / 29
        return [[tuple(r)] for r in np.einsum("nchw,ochw->no", x.astype(np.float64), weights).tolist()]


class Bright:
    """A detector without training: the probability of text in each pixel is how bright it is."""

    schema = "wide int, prob binary"

    def score_batch(self, x: np.ndarray, widths: list[int]) -> list[list[tuple]]:
        prep = PREPS["detector"]
        mean, deviation = (np.array(v)[:, None, None] for v in (prep.mean, prep.deviation))
        light = (x * deviation + mean).mean(1)
        light[(x == 0).all(1)] = 0  # filled up, not a picture's pixel
        return [[(w, np.ascontiguousarray(p[:, :w], np.float32).tobytes())] for p, w in zip(light, widths, strict=True)]


class TopLight:
    """An orientation classifier without training: a crop whose lower half is the brighter one is upside down."""

    schema = "upright double, turned double"

    def score_batch(self, x: np.ndarray, widths: list[int]) -> list[list[tuple]]:
        half = x.shape[2] // 2
        out = []
        for one, w in zip(x, widths, strict=True):
            more = float(one[:, :half, :w].mean() - one[:, half:, :w].mean())
            out.append([(0.95, 0.05) if more >= 0 else (0.05, 0.95)])
        return out


class Levels:
    """A recognizer without training: steps of 8 columns, whose class is how much ink their middle rows have, in `classes` levels; little of it is blank."""

    schema = "t int, cls int, val double"

    def __init__(self, classes: int = 4, least: float = 0.25) -> None:
        self.classes, self.least = classes, least

    def score_batch(self, x: np.ndarray, widths: list[int]) -> list[list[tuple]]:
        out = []
        for one, w in zip(x, widths, strict=True):
            ink = (1 - one[:, 18:30, :w].mean(0)) / 2
            steps = [float(np.median(ink[:, a : a + 8])) for a in range(0, w, 8)]
            level = [0 if v < self.least else 1 + min(int((v - self.least) / (1 - self.least) * self.classes), self.classes - 1) for v in steps]
            out.append([(t, c, v * 4) for t, (c, v) in enumerate(zip(level, steps, strict=True))])
        return out


class Stub:
    """A stand-in without weights: length and first byte of a blob; a null one has no row."""

    schema = "size long, first int"

    def score(self, content: pd.Series) -> list[list[tuple]]:
        return [[] if c is None else [(len(c), c[0] if len(c) else -1)] for c in content]


class Last(Stub):
    """Another stand-in: length and last byte."""

    def score(self, content: pd.Series) -> list[list[tuple]]:
        return [[] if c is None else [(len(c), c[-1] if len(c) else -1)] for c in content]


class Rows:
    """A stand-in for a recognizer: the sum of a row's pixels and the width that it was given."""

    schema = "total double, padded int"

    def score(self, wide: np.ndarray) -> list[tuple]:
        return [(float(t), wide.shape[1]) for t in wide.sum(1)]


register("linear", Linear)
register("bright", Bright)
register("top light", TopLight)
register("levels", Levels)
register("stub", Stub)
register("stub-last", Last)
register("stub-rows", Rows)
