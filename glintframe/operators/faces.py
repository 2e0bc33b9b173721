"""Embeddings of faces: crops with a margin, prepared and scored in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.operators.pixels import box_crops
from glintframe.operators.scorer import scored

# Pixels around a face, and the length of the vector of zeros for one of which too little is in the picture.
MARGIN, LENGTH = 10, 512


def embedded(pictures: DataFrame, faces: DataFrame, model: str, key: str = "path", length: int = LENGTH) -> DataFrame:
    """(key, part, embedding) of each face (key, part, x, y, w, h) of a picture (key, width, height, pixels).

    The model's columns, in order, are the embedding. A face of which less than 2 pixels a side are in
    the picture, or whose box has a null, has `length` zeros. Faces without a picture give no rows.
    """
    crops = box_crops(pictures, faces, MARGIN, key).select(F.struct(key, "part").alias("crop"), "width", "height", "pixels")
    found = scored(crops, "face", model, "crop")
    vectors = found.select("crop", F.array(*(F.col(c).cast("double") for c in found.columns if c != "crop")).alias("embedding"))
    whole = crops.select("crop").join(vectors, "crop", "left")
    return whole.select("crop.*", F.coalesce("embedding", F.array_repeat(F.lit(0.0), length)).alias("embedding"))
