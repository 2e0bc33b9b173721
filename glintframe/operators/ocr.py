"""Reading pictures: text boxes, straightened crops, their orientation, and their text, each model called in batches.

The models are plug-ins. Pictures, tensors and crops move between the steps as rows; a model's
batches hold crops of many pictures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators import ctc, grid
from glintframe.operators.pixels import CORNERS, PREPS, straight_crops
from glintframe.operators.scorer import scored
from glintframe.sources.images import as_text, from_text, given, image_of

_FOUND = pa.schema([("key", pa.string()), ("part", pa.int64()), *((c, pa.float64()) for c in [*CORNERS, "angle", "score"])])


def detected(pictures: DataFrame, detector: str, key: str = "path") -> DataFrame:
    """(key, part, x0, y0 .. x3, y3, angle, score): turned text boxes of pictures (key, width, height, pixels), corners in reading order, in pixels of the picture.

    The detector gives (wide, prob) for each tensor: rows of `wide` float32 probabilities. part is
    the box's component, in raster order. A picture without pixels has no boxes.
    """
    own = F.struct(F.col(key).alias("key"), F.col("width").alias("w"), F.col("height").alias("h")).alias("picture")
    maps = scored(pictures.select(own, "width", "height", "pixels"), "detector", detector, "picture")
    kind = pictures.schema[key].dataType
    size = PREPS["detector"].size

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, w, h, wide, prob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    new_w, new_h = size(w, h)
                    found = grid.turned_boxes(np.frombuffer(prob, np.float32).reshape(-1, wide)[:new_h, :new_w], w / new_w)
                    for part, cx, cy, bw, bh, angle, score in found:
                        corners = grid.in_reading_order(grid.corners_of(cx, cy, bw, bh, angle))
                        yield (name, part, *corners.ravel().tolist(), angle, score)

        yield from given(rows(), _FOUND, lambda r: 128)

    flat = maps.select(as_text(F.col("picture.key"), kind).alias("key"), "picture.w", "picture.h", "wide", "prob")
    out = flat.mapInArrow(boxes, ", ".join(f"{f.name} {'string' if f.name == 'key' else 'long' if f.name == 'part' else 'double'}" for f in _FOUND))
    return out.select(from_text(F.col("key"), kind).alias(key), *_FOUND.names[1:])


#: Probability over which a crop counts as upside down.
FLIPPED = 0.9


def upright(crops: DataFrame, classifier: str, key: str = "crop") -> DataFrame:
    """crops (key: distinct, width, height, pixels) with `flipped`, those upside down turned by half; crops without pixels are left out.

    The classifier gives (upright, turned), two probabilities: a crop is upside down if the second
    is the larger one and over FLIPPED.
    """
    kind = crops.schema[key].dataType
    found = scored(crops, "orientation", classifier, key)
    down = found.where((F.col("turned") > F.col("upright")) & (F.col("turned") > FLIPPED)).select(key, F.lit(True).alias("flipped"))
    marked = crops.where("pixels is not null").join(down, key, "left").select(as_text(F.col(key), kind).alias("key"), "width", "height", "pixels", F.coalesce("flipped", F.lit(False)).alias("flipped"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, p, flipped = (batch.column(c).to_pylist() for c in ("width", "height", "pixels", "flipped"))
            out = [image_of(x, a, b)[::-1, ::-1].tobytes() if f else x for a, b, x, f in zip(w, h, p, flipped, strict=True)]
            yield batch.set_column(3, "pixels", pa.array(out, pa.binary()))

    out = marked.mapInArrow(turn, "key string, width int, height int, pixels binary, flipped boolean")
    return out.select(from_text(F.col("key"), kind).alias(key), "width", "height", "pixels", "flipped")


def recognized(crops: DataFrame, recognizer: str, charset: DataFrame, key: str = "crop") -> DataFrame:
    """(key, text, score) of upright crops (key, width, height, pixels): greedy CTC; a crop without text gives no row.

    The recognizer gives (t, cls, val) for each step of a crop: its best class and that class's
    value. charset: (idx, chr), the blank at 0.
    """
    steps = scored(crops, "recognizer", recognizer, key)
    return ctc.text(ctc.symbols(steps.withColumnRenamed(key, "crop_id"), charset)).withColumnRenamed("crop_id", key)


def read(pictures: DataFrame, detector: str, classifier: str, recognizer: str, charset: DataFrame, key: str = "path") -> DataFrame:
    """(key, part, text, score, angle, corners) of the text in pictures (key, width, height, pixels): angle in degrees, with half a turn for upside-down crops.

    Boxes without text give no row.
    """
    boxes = detected(pictures, detector, key)
    crops = straight_crops(pictures, boxes, key).select(F.struct(key, "part").alias("crop"), "width", "height", "pixels")
    up = upright(crops, classifier)
    texts = recognized(up, recognizer, charset).join(up.select("crop", "flipped"), "crop")
    found = texts.select(f"crop.{key}", "crop.part", "text", "score", "flipped")
    angle = F.degrees("angle") + F.when(F.col("flipped"), 180.0).otherwise(0.0)
    return found.join(boxes.drop("score"), [key, "part"]).select(key, "part", "text", "score", angle.alias("angle"), *CORNERS)
