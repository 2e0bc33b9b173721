"""Pixels made ready for models: cubic resampling, normalized tensors, crops, straightened crops.

Pictures are rows (key, width, height, pixels) as decoded() gives them; tensors are float32,
channel by channel, as binary. A picture is resized by two banded weight tables, one a side,
that depend on the sizes only and are kept while a task runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from glintframe.sources.images import as_text, from_text, given, image_of

#: Digits to which sums are rounded before they become whole, so that halves don't hang on the order of adding.
DIGITS = 9


def cubic(x: np.ndarray) -> np.ndarray:
    """The Catmull-Rom kernel."""
    x = abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


@lru_cache(maxsize=256)
def taps(have: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(want x taps) positions among `have` and weights, which sum to 1; a kernel as wide as the pixels that one stands for."""
    ratio = have / want
    wide = max(ratio, 1.0)
    centre = (np.arange(want) + 0.5) * ratio
    first = np.clip(np.floor(centre - 2 * wide), 0, have - 1).astype(int)
    last = np.clip(np.ceil(centre + 2 * wide), first + 1, have).astype(int)
    at = first[:, None] + np.arange((last - first).max())
    weight = np.where(at < last[:, None], cubic((at - (centre[:, None] - 0.5)) / wide), 0.0)
    return np.minimum(at, have - 1), weight / weight.sum(1, keepdims=True)


def whole(values: np.ndarray) -> np.ndarray:
    out = np.round(values, DIGITS)
    out += 0.5
    np.floor(out, out)
    return np.clip(out, 0, 255, out).astype(np.uint8)


@lru_cache(maxsize=64)
def dense(have: int, want: int) -> np.ndarray | None:
    """taps as a matrix (want x have), where it is small or holds few zeros; else None."""
    at, weight = taps(have, want)
    if at.shape[1] * 8 < have:
        return None
    out = np.zeros((want, have))
    np.add.at(out, (np.arange(want)[:, None], at), weight)
    return out


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size, rows first and then columns."""
    if image.shape[:2] == (height, width):
        return image

    def along(values: np.ndarray, want: int) -> np.ndarray:
        if (matrix := dense(values.shape[0], want)) is not None:
            return (matrix @ values.reshape(values.shape[0], -1)).reshape(want, *values.shape[1:])
        at, weight = taps(values.shape[0], want)
        out = np.zeros((want, *values.shape[1:]))
        for k in range(at.shape[1]):
            out += weight[:, k, None, None] * values[at[:, k]]
        return out

    return whole(along(along(image, height).swapaxes(0, 1), width).swapaxes(0, 1))


@dataclass(frozen=True)
class Prep:
    """How pictures become a model's input.

    size: the picture's new width and height, from its old ones; padded: the tensor's, from the
    new ones, filled with zeros. Values are (v / unit - mean) / deviation by channel.
    """

    size: Callable[[int, int], tuple[int, int]]
    padded: Callable[[int, int], tuple[int, int]]
    mean: tuple[float, float, float]
    deviation: tuple[float, float, float]
    unit: float = 255.0
    invert_below: float | None = None  # mean luminance under which a picture is turned into its grey negative
    least: int = 1  # pictures with a shorter side have no tensor


def _same(w: int, h: int) -> tuple[int, int]:
    return w, h


def _exact(width: int, height: int) -> Callable[[int, int], tuple[int, int]]:
    return lambda w, h: (width, height)


def _at_most(longest: int, least: int) -> Callable[[int, int], tuple[int, int]]:
    def size(w: int, h: int) -> tuple[int, int]:
        scale = min(longest / max(w, h), 1.0)
        return max(int(w * scale), least), max(int(h * scale), least)

    return size


def _line(w: int, h: int) -> tuple[int, int]:
    return min(max(int(w / h * 48), 1), 2048), 48


def _by_32(w: int, h: int) -> tuple[int, int]:
    return -(-w // 32) * 32, -(-h // 32) * 32


# The models' input sizes, means and deviations.
HALF = (0.5, 0.5, 0.5)
PREPS = {
    "detector": Prep(_at_most(4096, 32), _by_32, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)),
    "orientation": Prep(_exact(192, 48), _same, HALF, HALF),
    "recognizer": Prep(_line, _same, HALF, HALF, invert_below=127.0, least=2),
    "encoder": Prep(_exact(224, 224), _same, (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)),
    "face detector": Prep(_at_most(640, 1), _exact(640, 640), (127.5, 127.5, 127.5), (128.0, 128.0, 128.0), unit=1.0),
    "face": Prep(_exact(112, 112), _same, (127.5, 127.5, 127.5), (127.5, 127.5, 127.5), unit=1.0, least=2),
}


def luminance(image: np.ndarray) -> np.ndarray:
    """Grey values, 0 to 255."""
    weights = np.array([2126, 7152, 722])  # fixed values: the share of red, green and blue in luminance
    return ((image.astype(np.int64) @ weights) // 10_000).astype(np.uint8)


@lru_cache(maxsize=64)
def normalized(prep: Prep) -> np.ndarray:
    """(channel x 256) what the values of a pixel become."""
    return ((np.arange(256)[:, None] / prep.unit - np.array(prep.mean)) / np.array(prep.deviation)).astype(np.float32).T.copy()


def tensor_of(image: np.ndarray, prep: Prep) -> np.ndarray | None:
    """Channels x height x width; None for a picture under the least side."""
    high, wide = image.shape[:2]
    if min(high, wide) < prep.least:
        return None
    if prep.invert_below is not None and (grey := luminance(image)).mean() < prep.invert_below:
        image = np.repeat((255 - grey)[..., None], 3, axis=2)
    w, h = prep.size(wide, high)
    pad_w, pad_h = prep.padded(w, h)
    out = np.zeros((3, pad_h, pad_w), np.float32)
    for plane, values, channel in zip(out, normalized(prep), resized(image, w, h).transpose(2, 0, 1), strict=True):
        plane[:h, :w] = values[channel]
    return out


def tensors_of(batches: Iterable[pa.RecordBatch], prep: Prep) -> Iterator[tuple[str, float | None, np.ndarray | None]]:
    """(key, scale, tensor) of each picture (key, width, height, pixels); both None for one without pixels or under the least side."""
    for batch in batches:
        for name, w, h, p in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            t = tensor_of(image_of(p.as_py(), w, h), prep) if p.is_valid and w and h else None
            yield name, None if t is None else prep.size(w, h)[0] / w, t


def prepared(pictures: DataFrame, model: str, key: str = "path") -> DataFrame:
    """key, width and height of the tensor, scale (tensor pixels a picture pixel along x, before padding) and tensor of each picture.

    A picture without pixels (null, or an error) or under the model's least side has nulls. Pictures
    are taken whole; one of them and a batch of about 16 MB are in a task's memory.
    """
    prep, kind = PREPS[model], pictures.schema[key].dataType
    schema = pa.schema([("key", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("scale", pa.float64()), ("tensor", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, None, None, None, None) if t is None else (k, t.shape[2], t.shape[1], scale, t.tobytes()) for k, scale, t in tensors_of(batches, prep))
        yield from given(rows, schema, lambda r: len(r[4] or b""))

    rows = pictures.select(as_text(F.col(key), kind).alias("key"), "width", "height", "pixels")
    out = rows.mapInArrow(run, "key string, width int, height int, scale double, tensor binary")
    return out.select(from_text(F.col("key"), kind).alias(key), "width", "height", "scale", "tensor")


def summarized(pictures: DataFrame, model: str, columns: str, made: Callable[[np.ndarray | None], list[tuple]], key: str = "path") -> DataFrame:
    """key and `columns` of the rows that `made` makes of each picture's tensor (None where prepared() has nulls), in the task that prepares it: tensors don't move as rows."""
    prep, kind = PREPS[model], pictures.schema[key].dataType
    fields = T.StructType([T.StructField("key", T.StringType()), *T.StructType.fromDDL(columns).fields])
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from given(((k, *row) for k, _, t in tensors_of(batches, prep) for row in made(t)), schema, lambda r: 64)

    rows = pictures.select(as_text(F.col(key), kind).alias("key"), "width", "height", "pixels")
    return rows.mapInArrow(run, fields).select(from_text(F.col("key"), kind).alias(key), *fields.names[1:])


def to_quad(width: float, height: float, corners: np.ndarray) -> np.ndarray | None:
    """Coefficients a to h that take (x, y) of a width x height rectangle to (ax + by + c, dx + ey + f) / (gx + hy + 1) in a quadrilateral.

    In closed form from the corners (upper left, upper right, lower right, lower left); None if
    the last three lie on a line.
    """
    p0, p1, p2, p3 = np.asarray(corners, float)
    right, down, skew = p1 - p2, p3 - p2, p0 - p1 + p2 - p3
    cross = right[0] * down[1] - right[1] * down[0]
    if abs(cross) < 1e-12:
        return None
    g, h = (skew[0] * down[1] - skew[1] * down[0]) / cross, (right[0] * skew[1] - right[1] * skew[0]) / cross
    ab, de = p1 - p0 + g * p1, p3 - p0 + h * p3
    return np.array([ab[0] / width, de[0] / height, p0[0], ab[1] / width, de[1] / height, p0[1], g / width, h / height])


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels, bilinear; beyond the border, the border's."""
    high, wide = image.shape[:2]
    x, y = np.clip(np.nan_to_num(x), 0, wide - 1), np.clip(np.nan_to_num(y), 0, high - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, wide - 1), np.minimum(y0 + 1, high - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    return whole(image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy)


def straightened(image: np.ndarray, corners: np.ndarray) -> np.ndarray | None:
    """The upright picture of a quadrilateral of corners in reading order; a quarter turn clockwise if it is 1.5 times as high as wide, or more.

    None if a side is under 2 pixels or the corners span no area.
    """
    c = np.asarray(corners, float)
    far = lambda i, j: float(np.hypot(*(c[i] - c[j])))
    wide, high = (int(np.floor(max(v) + 0.5)) for v in ((far(0, 1), far(3, 2)), (far(0, 3), far(1, 2))))
    if wide < 2 or high < 2 or (m := to_quad(wide, high, c)) is None:
        return None
    x, y = np.meshgrid(np.arange(wide, dtype=float), np.arange(high, dtype=float))
    below = m[6] * x + m[7] * y + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        out = sampled(image, (m[0] * x + m[1] * y + m[2]) / below, (m[3] * x + m[4] * y + m[5]) / below)
    out[abs(below) < 1e-10] = 0
    return np.rot90(out, -1) if high / wide >= 1.5 else out


def cut(image: np.ndarray, x: int, y: int, w: int, h: int, margin: int) -> np.ndarray | None:
    """The part of the image about a box, with a margin; None where less than 2 pixels a side are in the image."""
    x0, y0 = max(x - margin, 0), max(y - margin, 0)
    part = image[y0 : max(y0 + min(h + 2 * margin, image.shape[0] - y0), 0), x0 : max(x0 + min(w + 2 * margin, image.shape[1] - x0), 0)]
    return part if min(part.shape[:2]) >= 2 else None


def per_picture(pictures: DataFrame, parts: DataFrame, columns: list[str], one: Callable[[np.ndarray, tuple], np.ndarray | None], key: str, most: int) -> DataFrame:
    """(key, part, width, height, pixels) that `one` makes of a picture and each of its parts (key, part, columns); pixels are null where it gives None.

    A picture's parts meet it in lists of about `most`, so a picture with very many is in several
    tasks. Pictures without pixels or parts, and parts without a picture, give no rows.
    """
    kind = pictures.schema[key].dataType
    counts = parts.where(F.col(key).isNotNull()).groupBy(key).agg(F.ceil(F.count("*") / most).alias("lists"))
    listed = parts.join(counts, key).withColumn("list", F.pmod(F.xxhash64("part"), F.col("lists")))
    listed = listed.groupBy(key, "list").agg(F.array_sort(F.collect_list(F.struct("part", *columns))).alias("parts"))
    own = pictures.where("pixels is not null").select(key, F.col("width").alias("w"), F.col("height").alias("h"), "pixels")
    met = own.join(listed, key).select(as_text(F.col(key), kind).alias("key"), "w", "h", "pixels", "parts")
    schema = pa.schema([("key", pa.string()), ("part", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, w, h, p, each in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                    image = image_of(p.as_py(), w, h)
                    for part in each.as_py():
                        values = tuple(part[c] for c in columns)
                        made = None if any(v is None for v in values) else one(image, values)
                        yield (name, part["part"], *((None, None, None) if made is None else (made.shape[1], made.shape[0], np.ascontiguousarray(made).tobytes())))

        yield from given(rows(), schema, lambda r: len(r[4] or b""))

    out = met.mapInArrow(run, "key string, part long, width int, height int, pixels binary")
    return out.select(from_text(F.col("key"), kind).alias(key), "part", "width", "height", "pixels")


CORNERS = [f"{c}{i}" for i in range(4) for c in "xy"]


def straight_crops(pictures: DataFrame, quads: DataFrame, key: str = "path", most: int = 512) -> DataFrame:
    """(key, part, width, height, pixels) of each quadrilateral (key, part, x0, y0 .. x3, y3: upper left, upper right, lower right, lower left) of a picture."""
    return per_picture(pictures, quads, CORNERS, lambda image, c: straightened(image, np.array(c, float).reshape(4, 2)), key, most)


def box_crops(pictures: DataFrame, boxes: DataFrame, margin: int, key: str = "path", most: int = 512) -> DataFrame:
    """(key, part, width, height, pixels) of each box (key, part, x, y, w, h) of a picture, with a margin, inside the picture."""
    return per_picture(pictures, boxes, ["x", "y", "w", "h"], lambda image, b: cut(image, *(int(v) for v in b), margin), key, most)
