"""Queries over pictures whose pixels are the bytes of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.operators import pixels as P
from glintframe.operators.ocr import detected
from glintframe.operators.scorer import scored
from glintframe.plans.registry import query
from glintframe.sources import images as I
from glintframe.sources.tables import BOXES_SQL, boxes, spread, table

WIDE = 32
#: The same pictures in DuckDB SQL, pixels as hexadecimal digits.
PICTURES_SQL = f"""raw AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS hx FROM documents),
pictures AS (SELECT doc_id, {WIDE} AS width, high AS height, hx || repeat('0', CAST(high * {6 * WIDE} - length(hx) AS BIGINT)) AS hx FROM (SELECT *, CAST(greatest(ceil(length(hx) / {6.0 * WIDE}::DOUBLE), 1) AS INTEGER) AS high FROM raw))"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.text_pictures(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 4000), WIDE)


@query(f"""WITH {PICTURES_SQL} SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN width END AS width, CASE WHEN doc_id % 10 <> 3 THEN height END AS height,
  CASE WHEN doc_id % 10 <> 3 THEN md5(hx) END AS digest, doc_id % 10 = 3 AS invalid FROM pictures""")
def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as PNG with all filters or as pixmaps and read again; each tenth file is cut and gives an error row."""
    raw = pictures(spark, sf_dir)
    tenth = F.col("doc_id") % 10
    pixmap = F.concat(F.encode(F.format_string("P6\n# of a text\n%d %d\n255\n", F.col("width"), F.col("height")), "UTF-8"), F.col("pixels"))
    content = F.when(tenth == 3, F.substring("content", 1, F.octet_length("content") - 21)).otherwise(F.col("content"))
    files = I.encoded(raw.where(tenth != 4), "doc_id", (0, 1, 2, 3, 4)).select("doc_id", content.alias("content"))
    found = I.decoded(files.unionByName(raw.where(tenth == 4).select("doc_id", pixmap.alias("content"))), "doc_id")
    return found.select("doc_id", "width", "height", F.md5(F.hex("pixels")).alias("digest"), F.coalesce(F.startswith("error", F.lit("Invalid image")), F.lit(False)).alias("invalid"))


SIDE_W, SIDE_H = 20, 12
_MEAN, _DEVIATION = P.PREPS["detector"].mean, P.PREPS["detector"].deviation
#: The small twin of the detector's preparation: another size, the same padding and normalization.
SMALL = P.Prep(P._exact(SIDE_W, SIDE_H), P._by_32, _MEAN, _DEVIATION)
P.PREPS.setdefault("thumbnail", SMALL)


def _taps_sql(have: str, want: int, sizes: str) -> str:
    """(have, i, spot, weight): the weights of one side from `have` (a column of `sizes`) to `want` pixels."""
    x = f"abs((spot - (({{i}} + 0.5::DOUBLE) * have / {want} - 0.5)) / greatest(have / {want}.0::DOUBLE, 1.0::DOUBLE))".format(i="i")
    kernel = f"CASE WHEN {x} < 1 THEN (1.5 * {x} - 2.5) * {x} * {x} + 1 WHEN {x} < 2 THEN ((-0.5 * {x} + 2.5) * {x} - 4) * {x} + 2 ELSE 0.0 END"
    reach = f"2 * greatest(have / {want}.0::DOUBLE, 1.0::DOUBLE)"
    return f"""(SELECT have, i, spot, k / sum(k) OVER (PARTITION BY have, i) AS weight FROM (SELECT have, i, spot, {kernel} AS k FROM (
      SELECT have, i, unnest(range(lo, greatest(lo + 1, least(have, CAST(ceil((i + 0.5::DOUBLE) * have / {want} + {reach}) AS BIGINT))))) AS spot FROM (
        SELECT have, i, greatest(0, least(have - 1, CAST(floor((i + 0.5::DOUBLE) * have / {want} - {reach}) AS BIGINT))) AS lo FROM (SELECT DISTINCT {have} AS have FROM {sizes}), range({want}) r(i)))))"""


_SMALL_SQL = f"""{PICTURES_SQL}, v AS (SELECT doc_id, height, y, c, CAST('0x' || substr(hx, CAST((y * {3 * WIDE} + c) * 2 + 1 AS BIGINT), 2) AS INTEGER) AS v
  FROM (SELECT *, unnest(range({3 * WIDE})) AS c FROM (SELECT *, unnest(range(height)) AS y FROM pictures))),
down AS {_taps_sql("height", SIDE_H, "pictures")}, across AS {_taps_sql("width", SIDE_W, "pictures")},
t AS (SELECT doc_id, i AS y, c // 3 AS x, c % 3 AS channel, sum(weight * v) AS v FROM v JOIN down ON have = height AND spot = y GROUP BY ALL),
s AS (SELECT doc_id, y, i AS x, channel, least(greatest(floor(round(sum(weight * v), 9) + 0.5), 0), 255) AS v FROM t JOIN across ON spot = x GROUP BY doc_id, y, i, channel)"""


@query(f"""WITH {_SMALL_SQL} SELECT doc_id, CAST(channel AS INTEGER) AS channel, 32 AS w, 32 AS h, round(sum((v / 255 - [{', '.join(map(str, _MEAN))}][channel + 1]::DOUBLE) / [{', '.join(map(str, _DEVIATION))}][channel + 1]::DOUBLE) / 1024, 6) AS mean,
  md5(string_agg(printf('%02X', CAST(v AS INTEGER)), '' ORDER BY y, x)) AS digest FROM s GROUP BY doc_id, channel""")
def image_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic resampling, padding to multiples of 32 and normalization: means of the tensor's channels, and its bytes turned back to pixels."""
    mean, deviation = (np.array(v)[:, None, None] for v in (_MEAN, _DEVIATION))

    def means(t):
        h, w = t.shape[1:]
        each = t.astype(float)
        back = np.rint((each[:, :SIDE_H, :SIDE_W] * deviation + mean) * 255).astype(np.uint8)
        exact = (back / 255 - mean) / deviation
        return [(c, w, h, float(exact[c].sum() / (w * h)), float(each[c].sum() / (w * h)), back[c].tobytes()) for c in range(3)]

    each = P.summarized(pictures(spark, sf_dir), "thumbnail", "channel int, w int, h int, mean double, single double, pixels binary", means, "doc_id")
    close = F.when(F.abs(F.col("mean") - F.col("single")) < 1e-5, F.col("mean"))  # the tensor's own mean, in single precision, must agree
    return each.select("doc_id", "channel", "w", "h", F.round(close, 6).alias("mean"), F.md5(F.hex("pixels")).alias("digest"))


_QUADS_SQL = f"""{BOXES_SQL}, q AS (SELECT image_id AS doc_id, box_id AS part, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + w0 AS DOUBLE) AS x1, CAST(y0 + h % 3 AS DOUBLE) AS y1,
  CAST(x0 + w0 - h % 4 AS DOUBLE) AS x2, CAST(y0 + h0 AS DOUBLE) AS y2, CAST(x0 AS DOUBLE) AS x3, CAST(y0 + h0 - w % 2 AS DOUBLE) AS y3
  FROM (SELECT *, x % 36 - 4 AS x0, y % 36 - 4 AS y0, 1 + w % 13 AS w0, 1 + h % 17 AS h0 FROM boxes))"""


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skewed quadrilaterals about and beyond the pictures' borders, some of them without a width or height of two pixels."""
    c = F.col
    b = boxes(spark, sf_dir).select(c("image_id").alias("doc_id"), c("box_id").alias("part"), "w", "h", (c("x") % 36 - 4).alias("x0"), (c("y") % 36 - 4).alias("y0"), (1 + c("w") % 13).alias("w0"), (1 + c("h") % 17).alias("h0"))
    spots = {"x0": c("x0"), "y0": c("y0"), "x1": c("x0") + c("w0"), "y1": c("y0") + c("h") % 3, "x2": c("x0") + c("w0") - c("h") % 4, "y2": c("y0") + c("h0"), "x3": c("x0"), "y3": c("y0") + c("h0") - c("w") % 2}
    return b.select("doc_id", "part", *(v.cast("double").alias(k) for k, v in spots.items()))


_AT = lambda x, y: f"CAST('0x' || substr(hx, CAST(({y} * {WIDE} + {x}) * 6 + 2 * ch + 1 AS BIGINT), 2) AS INTEGER)"


@query(f"""WITH {PICTURES_SQL}, {_QUADS_SQL},
z AS (SELECT *, CAST(floor(greatest(sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2), sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)) + 0.5) AS INTEGER) AS wide,
  CAST(floor(greatest(sqrt((x0 - x3) ** 2 + (y0 - y3) ** 2), sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) + 0.5) AS INTEGER) AS high,
  (x1 - x2) * (y3 - y2) - (y1 - y2) * (x3 - x2) AS crossed, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy FROM q),
m AS (SELECT *, (sx * (y3 - y2) - sy * (x3 - x2)) / crossed AS g, ((x1 - x2) * sy - (y1 - y2) * sx) / crossed AS h FROM z WHERE wide >= 2 AND high >= 2 AND abs(crossed) >= 1e-12),
n AS (SELECT m.*, p.hx, p.height FROM m JOIN pictures p ON p.doc_id = m.doc_id),
o AS (SELECT doc_id, part, wide, high, hx, height, u, v, unnest([0, 1, 2]) AS ch, abs(g * u / wide + h * v / high + 1) < 1e-10 AS nowhere, least(greatest(((x1 - x0 + g * x1) * u / wide + (x3 - x0 + h * x3) * v / high + x0) / (g * u / wide + h * v / high + 1), 0), {WIDE - 1}) AS x,
  least(greatest(((y1 - y0 + g * y1) * u / wide + (y3 - y0 + h * y3) * v / high + y0) / (g * u / wide + h * v / high + 1), 0), height - 1) AS y
  FROM (SELECT *, unnest(range(high)) AS v FROM (SELECT *, unnest(range(wide)) AS u FROM n))),
f AS (SELECT *, CAST(floor(x) AS INTEGER) AS fx, CAST(floor(y) AS INTEGER) AS fy FROM o),
e AS (SELECT *, least(fx + 1, {WIDE - 1}) AS gx, least(fy + 1, height - 1) AS gy FROM f),
s AS (SELECT doc_id, part, wide, high, u, v, ch, CASE WHEN nowhere THEN 0 ELSE CAST(least(greatest(floor(round({_AT('fx', 'fy')} * (1 - x + fx) * (1 - y + fy) + {_AT('gx', 'fy')} * (x - fx) * (1 - y + fy) + {_AT('fx', 'gy')} * (1 - x + fx) * (y - fy) + {_AT('gx', 'gy')} * (x - fx) * (y - fy), 9) + 0.5), 0), 255) AS INTEGER) END AS p FROM e),
d AS (SELECT doc_id, part, wide, high, CAST(high AS DOUBLE) / wide >= 1.5 AS turned, md5(string_agg(printf('%02X', p), '' ORDER BY CASE WHEN CAST(high AS DOUBLE) / wide >= 1.5 THEN u ELSE v END, CASE WHEN CAST(high AS DOUBLE) / wide >= 1.5 THEN -v ELSE u END, ch)) AS digest FROM s GROUP BY ALL)
SELECT q.doc_id, q.part, CASE WHEN turned THEN high ELSE wide END AS width, CASE WHEN turned THEN wide ELSE high END AS height, digest FROM q JOIN pictures p ON p.doc_id = q.doc_id LEFT JOIN d ON d.doc_id = q.doc_id AND d.part = q.part""")
def straight_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals of each picture, straightened; whole crops."""
    crops = P.straight_crops(pictures(spark, sf_dir), _quads(spark, sf_dir), "doc_id")
    return crops.select("doc_id", F.col("part").cast("int").alias("part"), "width", "height", F.md5(F.hex("pixels")).alias("digest"))


@query(f"""WITH {PICTURES_SQL}, {BOXES_SQL}, b AS (SELECT image_id AS doc_id, box_id AS part, x % 52 - 10 AS x, y % 52 - 10 AS y, w % 16 AS w, h % 16 AS h FROM boxes),
c AS (SELECT b.doc_id, part, hx, greatest(x - 10, 0) AS x0, greatest(y - 10, 0) AS y0, least(w + 20, {WIDE} - greatest(x - 10, 0)) AS cw, least(h + 20, height - greatest(y - 10, 0)) AS ch FROM b JOIN pictures p ON p.doc_id = b.doc_id),
r AS (SELECT doc_id, part, cw, ch, md5(string_agg(substr(hx, CAST(((y0 + k) * {WIDE} + x0) * 6 + 1 AS BIGINT), CAST(cw * 6 AS BIGINT)), '' ORDER BY k)) AS digest FROM (SELECT *, unnest(range(ch)) AS k FROM c WHERE cw >= 2 AND ch >= 2) GROUP BY ALL)
SELECT c.doc_id, c.part, r.cw AS width, r.ch AS height, digest, CASE WHEN r.cw IS NULL THEN NULL ELSE 112 END AS tensor_side FROM c LEFT JOIN r ON r.doc_id = c.doc_id AND r.part = c.part""")
def face_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Face boxes cut from each picture with a margin of 10, and the side of the face model's tensor; nulls where less than 2 pixels a side are left."""
    c = F.col
    faces = boxes(spark, sf_dir).select(c("image_id").alias("doc_id"), c("box_id").alias("part"), (c("x") % 52 - 10).alias("x"), (c("y") % 52 - 10).alias("y"), (c("w") % 16).alias("w"), (c("h") % 16).alias("h"))
    crops = P.box_crops(pictures(spark, sf_dir), faces, 10, "doc_id")
    key = F.struct("doc_id", F.col("part").cast("int").alias("part"), "width", "height", F.md5(F.hex("pixels")).alias("digest"))
    ready = P.summarized(crops.withColumn("crop", key), "face", "tensor_side int", lambda t: [(None if t is None else t.shape[2],)], "crop")
    return ready.select("crop.*", "tensor_side")


_LINEAR = "((ch * 31 + y * 17 + x * 7 + {o} * 13) % 29 - 14) / 29.0::DOUBLE"


@query(f"""WITH {_SMALL_SQL}, z AS (SELECT doc_id, y, x, channel AS ch, CAST(CAST((v / 255 - [{', '.join(map(str, _MEAN))}][channel + 1]::DOUBLE) / [{', '.join(map(str, _DEVIATION))}][channel + 1]::DOUBLE AS FLOAT) AS DOUBLE) AS v FROM s)
SELECT doc_id, round(sum(v * {_LINEAR.format(o=0)}), 6) AS y0, round(sum(v * {_LINEAR.format(o=1)}), 6) AS y1 FROM z GROUP BY doc_id""")
def scorer_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tensors of all pictures through a linear model, many pictures in a call."""
    out = scored(pictures(spark, sf_dir), "thumbnail", "linear", "doc_id")
    return out.select("doc_id", F.round("y0", 6).alias("y0"), F.round("y1", 6).alias("y1"))


@query()
def rotated_box_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turned boxes of bright bars, one in each picture, through a detector called in batches; place, size and slope of the bar come from the document."""
    wide, high = 96, 64
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n")), "doc_id", 4000)
    docs = docs.select("doc_id", (40 + F.col("n") % 16).alias("cx"), (26 + F.col("n") % 12).alias("cy"), (8 + F.col("n") % 9).alias("half"), (F.col("n") % 7 * 0.15 - 0.45).alias("slope"))
    schema = pa.schema([("doc_id", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])

    def bars(batches):
        x, y = np.arange(wide), np.arange(high)[:, None]

        def rows():
            for batch in batches:
                for doc, cx, cy, half, slope in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    bar = np.zeros((high, wide), bool)  # of a null text
                    if cx is not None:
                        bar = (abs(x - cx + slope * (y - cy)) <= half) & (abs(y - cy - slope * (x - cx)) <= 5)
                    yield doc, wide, high, np.where(bar, np.uint8(0xE6), np.uint8(0x0D)).repeat(3).tobytes()

        yield from I.given(rows(), schema, lambda r: len(r[3]))

    made = docs.mapInArrow(bars, "doc_id long, width int, height int, pixels binary")
    found = detected(made, "bright", "doc_id")
    return found.select("doc_id", F.col("part").cast("int").alias("part"), *(F.round(c, 3).alias(c) for c in P.CORNERS), F.round("angle", 4).alias("angle"), F.round("score", 4).alias("score"))
