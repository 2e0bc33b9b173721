"""Queries over detected boxes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.operators import boxes as B
from glintframe.plans.registry import query
from glintframe.sources.tables import BOXES_SQL, boxes, table

_IOU = """CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) <= 0 THEN 0.0::DOUBLE
  ELSE CAST(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) AS DOUBLE)
  / ({a}.w * {a}.h + {b}.w * {b}.h - greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))) END"""


@query(f"WITH {BOXES_SQL} SELECT a.image_id, a.box_id AS box_a, b.box_id AS box_b, round({_IOU.format(a='a', b='b')}, 6) AS iou FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id WHERE {_IOU.format(a='a', b='b')} > 0.2")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one image that overlap by more than 0.2; the equal image keeps the join from growing with the table squared."""
    every = F.struct("box_id", "x", "y", "w", "h")
    rows = boxes(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(every)).alias("all"))
    a = rows.select("image_id", "all", F.explode("all").alias("a"))
    later = a.select("image_id", "a", F.explode(F.filter("all", lambda b: b["box_id"] > F.col("a")["box_id"])).alias("b"))
    overlap = B.iou(F.col("a"), F.col("b"))
    return later.where(overlap > 0.2).select("image_id", F.col("a.box_id").alias("box_a"), F.col("b.box_id").alias("box_b"), F.round(overlap, 6).alias("iou"))


@query(f"""WITH {BOXES_SQL},
g AS (SELECT image_id, list({{'box_id': box_id, 'x': x, 'y': y, 'w': w, 'h': h, 'c': confidence}} ORDER BY confidence DESC, box_id) AS l FROM boxes GROUP BY image_id),
k AS (SELECT image_id, unnest(list_reduce(list_transform(l, lambda b: [b]), lambda acc, one:
  CASE WHEN len(list_filter(acc, lambda k: {_IOU.format(a="k", b="one[1]")} > 0.4)) > 0 THEN acc ELSE list_concat(acc, one) END)) AS b FROM g)
SELECT image_id, b.box_id AS box_id, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.c AS confidence FROM k""")
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.nms(boxes(spark, sf_dir))


_ANCHORS = "l_linenumber % 3 AS s, l_partkey AS p, l_suppkey AS k"


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [8, 16, 32][l_linenumber % 3 + 1] AS stride, (l_partkey * 13 + l_suppkey) % 800 AS idx,
  round((l_partkey % 100) / 100.0::DOUBLE, 2) AS score, (l_suppkey % 7) / 2.0::DOUBLE AS dl, (l_partkey % 5) / 2.0::DOUBLE AS dt, (l_partkey % 9) / 4.0::DOUBLE AS dr, (l_suppkey % 11) / 4.0::DOUBLE AS db, 0.8::DOUBLE AS scale
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)),
c AS (SELECT *, ((idx // 2) % (640 // stride)) * stride AS cx, ((idx // 2) // (640 // stride)) * stride AS cy FROM a WHERE score >= 0.5),
d AS (SELECT *, CAST(trunc((cx - dl * stride) / scale) AS INTEGER) AS x1, CAST(trunc((cy - dt * stride) / scale) AS INTEGER) AS y1,
  CAST(trunc((cx + dr * stride) / scale) AS INTEGER) AS x2, CAST(trunc((cy + db * stride) / scale) AS INTEGER) AS y2 FROM c)
SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, greatest(x1, 0) AS x, greatest(y1, 0) AS y, greatest(x2 - x1, 1) AS w, greatest(y2 - y1, 1) AS h, score FROM d""")
def anchor_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of detector anchors of three strides that score 0.5 or more."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    c = F.col
    a = table(spark, sf_dir, "lineitem").select(*keys).distinct().withColumn("score", F.round((c("l_partkey") % 100) / 100.0, 2)).where("score >= 0.5")
    stride = F.element_at(F.array(F.lit(8), F.lit(16), F.lit(32)), (c("l_linenumber") % 3 + 1).cast("int"))
    box = B.anchor_box((c("l_partkey") * 13 + c("l_suppkey")) % 800, stride, 2, 640, (c("l_suppkey") % 7) / 2.0, (c("l_partkey") % 5) / 2.0, (c("l_partkey") % 9) / 4.0, (c("l_suppkey") % 11) / 4.0, F.lit(0.8))
    return a.select(*keys, "score", box.alias("b")).select(c("l_orderkey").alias("image_id"), *keys[1:], "b.x", "b.y", "b.w", "b.h", "score")


@query(f"""WITH {BOXES_SQL}, s AS (SELECT image_id, box_id, x - 10 AS x, y - 10 AS y, w, h FROM boxes),
f AS (SELECT *, greatest(x, 0) AS fx, greatest(y, 0) AS fy FROM s),
g AS (SELECT image_id, box_id, fx, fy, least(w, 160 - fx) AS fw, least(h, 120 - fy) AS fh FROM f)
SELECT image_id, box_id, fx AS x, fy AS y, fw AS w, fh AS h, greatest(fx - 10, 0) AS crop_x, greatest(fy - 10, 0) AS crop_y,
  least(fx + fw + 10, 160) - greatest(fx - 10, 0) AS crop_w, least(fy + fh + 10, 120) - greatest(fy - 10, 0) AS crop_h FROM g""")
def face_box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face boxes kept in a 160 x 120 image, and their crops with a margin of 10."""
    c = F.col
    faces = boxes(spark, sf_dir).select("image_id", "box_id", *B.clamped_face(c("x") - 10, c("y") - 10, c("w"), c("h"), 160, 120))
    crop = B.padded_crop(c("x"), c("y"), c("w"), c("h"), 160, 120, pad=10)
    return faces.select("*", *crop).withColumnsRenamed({"x1": "crop_x", "y1": "crop_y", "cw": "crop_w", "ch": "crop_h"})


@query(f"""WITH {BOXES_SQL}, p AS (SELECT image_id, box_id, greatest(x - 3, 0) AS x1, greatest(y - 3, 0) AS y1, least(x + w + 3, 180) - greatest(x - 3, 0) AS cw, least(y + h + 3, 130) - greatest(y - 3, 0) AS ch FROM boxes)
SELECT * FROM p WHERE cw >= 2 AND ch >= 2""")
def crop_axis_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return boxes(spark, sf_dir).select("image_id", "box_id", *B.padded_crop(c("x"), c("y"), c("w"), c("h"), 180, 130)).where("cw >= 2 and ch >= 2")


@query(f"""WITH {BOXES_SQL}, g AS (SELECT *, CASE WHEN w + h > 0 THEN w * h * 1.6::DOUBLE / (2.0::DOUBLE * (w + h)) ELSE 0.0::DOUBLE END AS grow FROM boxes),
u AS (SELECT *, greatest(x - grow, 0.0::DOUBLE) AS ux, greatest(y - grow, 0.0::DOUBLE) AS uy FROM g)
SELECT image_id, box_id, round(grow, 6) AS grow, round(ux, 6) AS ux, round(uy, 6) AS uy, round(least(w + 2 * grow, 200 - ux), 6) AS uw, round(least(h + 2 * grow, 150 - uy), 6) AS uh FROM u""")
def unclip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    grown = boxes(spark, sf_dir).select("image_id", "box_id", *B.unclipped(c("x"), c("y"), c("w"), c("h"), 200, 150, 1.6))
    return grown.select("image_id", "box_id", *(F.round(n, 6).alias(n) for n in ("grow", "ux", "uy", "uw", "uh")))


@query("""WITH d AS (SELECT p_partkey, CAST(p_partkey * 37 % 12000 + 1 AS INTEGER) AS w, CAST(p_partkey * 91 % 11000 + 1 AS INTEGER) AS h FROM part),
s AS (SELECT *, least(4096.0::DOUBLE / greatest(w, h), 1.0::DOUBLE) AS scale, least(640.0::DOUBLE / greatest(w, h), 1.0::DOUBLE) AS face FROM d),
n AS (SELECT *, greatest(CAST(trunc(w * scale) AS INTEGER), 32) AS nw, greatest(CAST(trunc(h * scale) AS INTEGER), 32) AS nh FROM s)
SELECT p_partkey, w, h, round(scale, 6) AS scale, nw, nh, CAST(((nw + 31) // 32) * 32 AS INTEGER) AS pad_w, CAST(((nh + 31) // 32) * 32 AS INTEGER) AS pad_h, round(face, 6) AS face_scale, w > 10000 OR h > 10000 AS too_large FROM n""")
def detect_resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector input sizes: longest side at most 4096, sides at least 32 and padded to 32; face detector scale; size guard."""
    d = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 12000 + 1).cast("int").alias("w"), (F.col("p_partkey") * 91 % 11000 + 1).cast("int").alias("h"))
    longest = F.greatest("w", "h")
    d = d.withColumn("scale", F.least(4096.0 / longest, F.lit(1.0))).withColumn("face", F.least(640.0 / longest, F.lit(1.0)))
    side = lambda c: F.greatest((F.col(c) * F.col("scale")).cast("int"), F.lit(32))
    pad = lambda c: (F.ceil(F.col(c) / 32) * 32).cast("int")
    d = d.withColumn("nw", side("w")).withColumn("nh", side("h"))
    return d.select("p_partkey", "w", "h", F.round("scale", 6).alias("scale"), "nw", "nh", pad("nw").alias("pad_w"), pad("nh").alias("pad_h"), F.round("face", 6).alias("face_scale"), ((F.col("w") > 10000) | (F.col("h") > 10000)).alias("too_large"))


@query(f"""WITH {BOXES_SQL}, r AS (SELECT image_id, box_id, least(greatest(CAST(trunc(CAST(w AS DOUBLE) / h * 48) AS INTEGER), 1), 2048) AS rw FROM boxes WHERE w >= 2 AND h >= 2)
SELECT image_id, box_id, rw, max(rw) OVER (PARTITION BY image_id) AS batch_w FROM r""")
def recognizer_width_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer input widths at height 48 and the width that an image's batch is padded to."""
    width = F.least(F.greatest((F.col("w").cast("double") / F.col("h") * 48).cast("int"), F.lit(1)), F.lit(2048))
    rows = boxes(spark, sf_dir).where("w >= 2 and h >= 2").select("image_id", "box_id", width.alias("rw"))
    return rows.withColumn("batch_w", F.max("rw").over(Window.partitionBy("image_id")))


_QUAD = "[{'x': x, 'y': y}, {'x': x + w, 'y': y + h % 7}, {'x': x + w - h % 5, 'y': y + h}, {'x': x + w % 3, 'y': y + h - w % 4}]"


def _quad():
    c = F.col
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(p(c("x") + c("w") - c("h") % 5, c("y") + c("h")), p(c("x"), c("y")), p(c("x") + c("w") % 3, c("y") + c("h") - c("w") % 4), p(c("x") + c("w"), c("y") + c("h") % 7))


@query(f"""WITH {BOXES_SQL}, s AS (SELECT image_id, box_id, list_sort({_QUAD}) AS s FROM boxes),
o AS (SELECT image_id, box_id, CASE WHEN s[1].y <= s[2].y THEN s[1] ELSE s[2] END AS tl, CASE WHEN s[1].y <= s[2].y THEN s[2] ELSE s[1] END AS bl,
  CASE WHEN s[3].y <= s[4].y THEN s[3] ELSE s[4] END AS tr, CASE WHEN s[3].y <= s[4].y THEN s[4] ELSE s[3] END AS br FROM s),
d AS (SELECT *, greatest(sqrt((tl.x - tr.x) ** 2 + (tl.y - tr.y) ** 2), sqrt((bl.x - br.x) ** 2 + (bl.y - br.y) ** 2)) AS cw, greatest(sqrt((tl.x - bl.x) ** 2 + (tl.y - bl.y) ** 2), sqrt((tr.x - br.x) ** 2 + (tr.y - br.y) ** 2)) AS ch FROM o)
SELECT image_id, box_id, tl.x AS tlx, tl.y AS tly, tr.x AS trx, tr.y AS try_, br.x AS brx, br.y AS bry, bl.x AS blx, bl.y AS bly,
  CAST(greatest(round(cw), 1) AS INTEGER) AS out_w, CAST(greatest(round(ch), 1) AS INTEGER) AS out_h, greatest(round(ch), 1) / greatest(round(cw), 1) >= 1.5 AS turned FROM d""")
def order_quad_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in order, the size of the straightened crop, and whether it is turned upright."""
    q = boxes(spark, sf_dir).select("image_id", "box_id", B.ordered_corners(_quad()).alias("q"))
    names = ("tl", "tr", "br", "bl")
    q = q.select("image_id", "box_id", *(F.get("q", i).alias(n) for i, n in enumerate(names)))
    far = lambda a, b: F.hypot(F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y"))
    side = lambda p, r: F.greatest(F.round(F.greatest(p, r)), F.lit(1.0))
    w, h = side(far("tl", "tr"), far("bl", "br")), side(far("tl", "bl"), far("tr", "br"))
    spots = [F.col(f"{n}.{k}").alias(f"{n}{k}" if f"{n}{k}" != "try" else "try_") for n in names for k in "xy"]
    return q.select("image_id", "box_id", *spots, w.cast("int").alias("out_w"), h.cast("int").alias("out_h"), (h / w >= 1.5).alias("turned"))


@query(f"""WITH {BOXES_SQL}, a AS (SELECT *, (box_id * 37 + x) % 360 * pi() / 180 AS raw FROM boxes),
n AS (SELECT *, CASE WHEN raw > pi() / 2 THEN raw - pi() * ceil((raw - pi() / 2) / pi()) ELSE raw END AS angle FROM a)
SELECT image_id, box_id, round(degrees(angle), 6) AS angle_deg, round(degrees(angle) + CASE WHEN confidence > 0.5 THEN 180 ELSE 0 END, 6) AS shown_deg,
  round(x - w / 2.0::DOUBLE * cos(angle) + h / 2.0::DOUBLE * sin(angle), 4) AS x0, round(y - w / 2.0::DOUBLE * sin(angle) - h / 2.0::DOUBLE * cos(angle), 4) AS y0,
  round(x + w / 2.0::DOUBLE * cos(angle) - h / 2.0::DOUBLE * sin(angle), 4) AS x2, round(y + w / 2.0::DOUBLE * sin(angle) + h / 2.0::DOUBLE * cos(angle), 4) AS y2 FROM n""")
def rect_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opposite corners of rectangles about (x, y), angles brought into a half turn."""
    c = F.col
    raw = (c("box_id") * 37 + c("x")) % 360 * F.lit(math.pi) / 180
    half = F.lit(math.pi / 2)
    rows = boxes(spark, sf_dir).withColumn("raw", raw).withColumn("angle", F.when(c("raw") > half, c("raw") - math.pi * F.ceil((c("raw") - half) / math.pi)).otherwise(c("raw")))
    p = B.rotated_corners(c("x"), c("y"), c("w").cast("double"), c("h").cast("double"), c("angle"))
    shown = F.degrees("angle") + F.when(c("confidence") > 0.5, 180).otherwise(0)
    return rows.select("image_id", "box_id", F.round(F.degrees("angle"), 6).alias("angle_deg"), F.round(shown, 6).alias("shown_deg"), F.round(p[0][0], 4).alias("x0"), F.round(p[0][1], 4).alias("y0"), F.round(p[2][0], 4).alias("x2"), F.round(p[2][1], 4).alias("y2"))


@query(f"""WITH {BOXES_SQL}, q AS (SELECT image_id, box_id, {_QUAD} AS q FROM boxes)
SELECT image_id, box_id, round(CAST(list_min(list_transform(q, lambda p: p.x)) AS DOUBLE) / 3, 2) AS x, round(CAST(list_min(list_transform(q, lambda p: p.y)) AS DOUBLE) / 3, 2) AS y,
  round(CAST(list_max(list_transform(q, lambda p: p.x)) - list_min(list_transform(q, lambda p: p.x)) AS DOUBLE) / 3, 2) AS w, round(CAST(list_max(list_transform(q, lambda p: p.y)) - list_min(list_transform(q, lambda p: p.y)) AS DOUBLE) / 3, 2) AS h FROM q""")
def polygon_to_aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("image_id", "box_id", _quad().alias("q"))
    x, y = F.transform("q", lambda p: p["x"]), F.transform("q", lambda p: p["y"])
    third = lambda v: F.round(v / 3.0, 2)
    return rows.select("image_id", "box_id", third(F.array_min(x)).alias("x"), third(F.array_min(y)).alias("y"), third(F.array_max(x) - F.array_min(x)).alias("w"), third(F.array_max(y) - F.array_min(y)).alias("h"))


@query(f"WITH {BOXES_SQL} SELECT image_id, box_id, least(x, w) AS x, least(y, h) AS y, abs(w - x) AS w, abs(h - y) AS h FROM boxes")
def xyxy_to_xywh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners (x, y) and (w, h), in either order, as origin and size."""
    c = F.col
    return boxes(spark, sf_dir).select("image_id", "box_id", F.least("x", "w").alias("x"), F.least("y", "h").alias("y"), F.abs(c("w") - c("x")).alias("w"), F.abs(c("h") - c("y")).alias("h"))


@query(f"""WITH {BOXES_SQL} SELECT image_id, box_id, CASE WHEN box_id % 3 = 0 THEN x WHEN box_id % 3 = 1 THEN x + 1 ELSE 0 END AS x, CASE WHEN box_id % 3 = 2 THEN 640 ELSE w END AS w,
  CASE WHEN box_id % 2 = 0 THEN confidence ELSE 0.5::DOUBLE END AS score FROM boxes""")
def box_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognized box, else the detected polygon's bounds, else the whole image; a missing score is 0.5."""
    c = F.col
    kind = c("box_id") % 3
    rec_x, poly_x = F.when(kind == 0, c("x")), F.when(kind == 1, c("x") + 1)
    width = F.when(kind != 2, c("w"))
    score = F.when(c("box_id") % 2 == 0, c("confidence"))
    return boxes(spark, sf_dir).select("image_id", "box_id", F.coalesce(rec_x, poly_x, F.lit(0)).alias("x"), F.coalesce(width, F.lit(640)).alias("w"), F.coalesce(score, F.lit(0.5)).alias("score"))


@query(f"""WITH {BOXES_SQL}, n AS (SELECT image_id, box_id, CASE WHEN box_id % 4 <> 1 THEN CAST(x AS DOUBLE) END AS x, CASE WHEN box_id % 5 <> 2 THEN CAST(y AS DOUBLE) END AS y FROM boxes)
SELECT image_id, box_id, coalesce(x, -1.0::DOUBLE) AS x, coalesce(y, -1.0::DOUBLE) AS y, coalesce(x, -1) >= 0 AND coalesce(y, -1) >= 0 AS placed FROM n""")
def null_box_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null coordinates leave the engine as -1; only placed boxes go on to merging."""
    rows = boxes(spark, sf_dir).select("image_id", "box_id", F.when(F.col("box_id") % 4 != 1, F.col("x").cast("double")).alias("x"), F.when(F.col("box_id") % 5 != 2, F.col("y").cast("double")).alias("y"))
    x, y = F.coalesce("x", F.lit(-1.0)), F.coalesce("y", F.lit(-1.0))
    return rows.select("image_id", "box_id", x.alias("x"), y.alias("y"), ((x >= 0) & (y >= 0)).alias("placed"))


@query(f"WITH {BOXES_SQL} SELECT image_id, box_id, confidence > 1 - confidence AND confidence > 0.9 AS flip, CASE WHEN confidence > 1 - confidence AND confidence > 0.9 THEN 180 ELSE 0 END AS angle FROM boxes")
def orientation_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upside down when that class is the likelier one and over 0.9."""
    flip = (F.col("confidence") > 1 - F.col("confidence")) & (F.col("confidence") > 0.9)
    return boxes(spark, sf_dir).select("image_id", "box_id", flip.alias("flip"), F.when(flip, 180).otherwise(0).alias("angle"))


@query(f"""WITH {BOXES_SQL} SELECT image_id, box_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS k FROM boxes WHERE confidence >= 0.3) WHERE k <= 3""")
def top_candidates_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidates of an image in scan order, not the best."""
    k = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id"))
    return boxes(spark, sf_dir).where("confidence >= 0.3").withColumn("k", k).where("k <= 3").select("image_id", "box_id", "confidence")


@query(f"""WITH {BOXES_SQL}, r AS (SELECT image_id, box_id, x, y, w, h, CASE WHEN h % 10 = 0 THEN 'inf'::DOUBLE WHEN h % 10 = 1 THEN 'nan'::DOUBLE ELSE CAST(h AS DOUBLE) END AS side FROM boxes)
SELECT image_id, box_id FROM r WHERE w * h >= 900 AND w >= 3 AND h >= 3 AND isfinite(side) AND w <= trunc(0.8 * 64) AND h <= trunc(0.8 * 80)""")
def component_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of enough area, finite, and not wider or taller than 0.8 of the image."""
    h = F.col("h")
    side = F.when(h % 10 == 0, F.lit(float("inf"))).when(h % 10 == 1, F.lit(float("nan"))).otherwise(h.cast("double"))
    rows = boxes(spark, sf_dir).withColumn("side", side)
    return rows.where("w * h >= 900 and w >= 3 and h >= 3 and not isnan(side) and side < double('Infinity') and w <= int(0.8 * 64) and h <= int(0.8 * 80)").select("image_id", "box_id")


@query(f"""WITH {BOXES_SQL} SELECT image_id, box_id, round(sqrt((x - w) ** 2 + (y - h) ** 2), 6) AS far, round((x + w) / 2.0::DOUBLE, 6) AS mid_x, x * h - y * w AS crossed,
  greatest(x - 50, 0) AS saturated, CAST((w + 6) // 7 AS INTEGER) AS blocks, CAST(trunc(-confidence * 10) AS INTEGER) AS cut FROM boxes""")
def point_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, midpoint, cross product, saturating difference, rounded-up quotient, truncation."""
    c = F.col
    return boxes(spark, sf_dir).select("image_id", "box_id", F.round(F.hypot(c("x") - c("w"), c("y") - c("h")), 6).alias("far"), F.round((c("x") + c("w")) / 2.0, 6).alias("mid_x"), (c("x") * c("h") - c("y") * c("w")).alias("crossed"), F.greatest(c("x") - 50, F.lit(0)).alias("saturated"), F.ceil(c("w") / 7).cast("int").alias("blocks"), (-c("confidence") * 10).cast("int").alias("cut"))
