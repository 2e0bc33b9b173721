"""Box geometry and greedy suppression as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs with x, y, w, h; 0 if the union is not positive."""
    wide = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    high = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    inter = (wide * high).cast("double")
    union = (a["w"] * a["h"] + b["w"] * b["h"]).cast("double") - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)


def nms(boxes: DataFrame, limit: float = 0.4) -> DataFrame:
    """Boxes that stay: by falling confidence (ties: box_id) each stays unless it overlaps a kept one by more than limit.

    One image's boxes are folded in one array; images are bounded by what a detector gives. Boxes with
    a null in a side or the confidence are left out.
    """
    boxes = boxes.dropna(subset=["x", "y", "w", "h", "confidence"])
    box = F.struct((-F.col("confidence")).alias("c"), "box_id", "x", "y", "w", "h")
    ordered = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(box)).alias("all"))
    none = F.slice(F.col("all"), 1, 0)
    kept = F.aggregate("all", none, lambda acc, b: F.when(F.exists(acc, lambda k: iou(k, b) > limit), acc).otherwise(F.concat(acc, F.array(b))))
    one = ordered.select("image_id", F.explode(kept).alias("b"))
    return one.select("image_id", "b.box_id", "b.x", "b.y", "b.w", "b.h", (-F.col("b.c")).alias("confidence"))


def anchor_box(idx: Column, stride: Column, per_place: int, width: int, left: Column, top: Column, right: Column, bottom: Column, scale: Column) -> Column:
    """struct(x, y, w, h) of an anchor: origin at its cell's upper left; sizes come from the unclamped corner, at least 1."""
    place = F.floor(idx / per_place)
    cells = F.floor(F.lit(width) / stride)
    cx, cy = (place % cells) * stride, F.floor(place / cells) * stride
    whole = lambda c: c.cast("int")
    x1, y1 = whole((cx - left * stride) / scale), whole((cy - top * stride) / scale)
    x2, y2 = whole((cx + right * stride) / scale), whole((cy + bottom * stride) / scale)
    return F.struct(F.greatest(x1, F.lit(0)).alias("x"), F.greatest(y1, F.lit(0)).alias("y"), F.greatest(x2 - x1, F.lit(1)).alias("w"), F.greatest(y2 - y1, F.lit(1)).alias("h"))


def clamped_face(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> list[Column]:
    cx, cy = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    return [cx.alias("x"), cy.alias("y"), F.least(w, width - cx).alias("w"), F.least(h, height - cy).alias("h")]


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: int, height: int, pad: int = 3) -> list[Column]:
    """A crop grown by pad and kept inside the image."""
    x1, y1 = F.greatest(x - pad, F.lit(0)), F.greatest(y - pad, F.lit(0))
    return [x1.alias("x1"), y1.alias("y1"), (F.least(x + w + pad, F.lit(width)) - x1).alias("cw"), (F.least(y + h + pad, F.lit(height)) - y1).alias("ch")]


def unclipped(x: Column, y: Column, w: Column, h: Column, width: int, height: int, ratio: float) -> list[Column]:
    """A shrunken text box grown back by area * ratio / perimeter. Clamping at 0 does not narrow it; the far side does."""
    round_ = 2.0 * (w + h)
    grow = F.when(round_ > 0, w * h * F.lit(ratio) / round_).otherwise(F.lit(0.0))
    ux, uy = F.greatest(x - grow, F.lit(0.0)), F.greatest(y - grow, F.lit(0.0))
    return [grow.alias("grow"), ux.alias("ux"), uy.alias("uy"), F.least(w + 2 * grow, width - ux).alias("uw"), F.least(h + 2 * grow, height - uy).alias("uh")]


def ordered_corners(points: Column) -> Column:
    """Four structs (x, y) as upper left, upper right, lower right, lower left: two by x on each side, then by y."""
    s = F.array_sort(points)
    at = lambda i: F.get(s, i)
    left_up, right_up = at(0)["y"] <= at(1)["y"], at(2)["y"] <= at(3)["y"]
    pick = lambda c, i, j: F.when(c, at(i)).otherwise(at(j))
    return F.array(pick(left_up, 0, 1), pick(right_up, 2, 3), pick(right_up, 3, 2), pick(left_up, 1, 0))


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> list[tuple[Column, Column]]:
    """Corners of a rectangle turned about its centre, from the upper left clockwise."""
    c, s = F.cos(angle), F.sin(angle)
    return [(cx + dx * w / 2 * c - dy * h / 2 * s, cy + dx * w / 2 * s + dy * h / 2 * c) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
