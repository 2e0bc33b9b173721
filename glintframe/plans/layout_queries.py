"""Queries over laid-out lines, recognizer frames, and text alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.operators import align, ctc, layout, restore
from glintframe.plans.registry import query
from glintframe.sources.tables import LINES_SQL, literal, table, text_lines

_EDGES = f"""{LINES_SQL},
edges AS (
  SELECT a.image_id, a.line_id AS a, b.line_id AS b FROM lines a JOIN lines b ON a.image_id = b.image_id AND (a.y, a.x, a.line_id) < (b.y, b.x, b.line_id)
  WHERE least(a.w, b.w) > 0 AND greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) / least(a.w, b.w) >= 0.5 AND greatest(b.y - a.y - a.h, 0) <= (a.h + b.h) / 2 * 1.5)"""


@query(f"WITH {_EDGES} SELECT image_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM edges")
def paragraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraph_edges(text_lines(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES},
both_ AS (SELECT image_id, a, b FROM edges UNION ALL SELECT image_id, b, a FROM edges),
reach(image_id, id, r) AS (SELECT image_id, line_id, line_id FROM lines UNION SELECT reach.image_id, reach.id, e.b FROM reach JOIN both_ e ON e.image_id = reach.image_id AND e.a = reach.r),
pos AS (SELECT image_id, line_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, line_id) AS p FROM lines),
first AS (SELECT reach.image_id, reach.id, min(pos.p) AS f FROM reach JOIN pos ON pos.image_id = reach.image_id AND pos.line_id = reach.r GROUP BY ALL)
SELECT image_id, CAST(id AS INTEGER) AS line_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY f) - 1 AS INTEGER) AS paragraph_id FROM first""")
def paragraph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraphs(text_lines(spark, sf_dir))


_CLASSES = {"error": 0, "view": 1, "signup": 2, "purchase": 3, "click": 4}
_FRAMES = """frames AS (SELECT user_id AS crop_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS t, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS cls,
  value / 100 AS val, 320.0::DOUBLE AS box_w, count(*) OVER (PARTITION BY user_id) AS seq_len FROM events),
prev AS (SELECT *, lag(cls, 1, 0) OVER (PARTITION BY crop_id ORDER BY t) AS before FROM frames),
moved AS (SELECT *, CASE WHEN cls <> 0 AND cls <> before THEN t WHEN cls = 0 AND before <> 0 THEN t + 1 END AS m FROM prev),
starts AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY crop_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM moved),
emitted AS (SELECT s.*, c.chr, 1 / (1 + exp(-val)) AS score FROM starts s JOIN (VALUES (1, 'v'), (2, 's'), (3, 'p')) AS c(idx, chr) ON c.idx = s.cls WHERE cls <> 0 AND cls <> before)"""


def _emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = Window.partitionBy("user_id")
    cls = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in _CLASSES.items()))
    frames = table(spark, sf_dir, "events").select(F.col("user_id").alias("crop_id"), (F.row_number().over(one.orderBy("ts")) - 1).alias("t"), cls.alias("cls"), (F.col("value") / 100).alias("val"), F.lit(320.0).alias("box_w"), F.count("*").over(one).alias("seq_len"))
    return ctc.symbols(frames, literal(spark, "idx, chr", [(1, "v"), (2, "s"), (3, "p")]))


@query(f"WITH {_FRAMES} SELECT crop_id, string_agg(chr, '' ORDER BY t) AS text FROM emitted GROUP BY crop_id")
def ctc_collapse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.text(_emitted(spark, sf_dir)).select("crop_id", "text")


@query(f"WITH {_FRAMES} SELECT crop_id, CAST(t AS INTEGER) AS t, chr, round(start * (box_w / seq_len), 6) AS x, round((t - start + 1) * (box_w / seq_len), 6) AS w FROM emitted")
def ctc_char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.spans(_emitted(spark, sf_dir)).select("crop_id", "t", "chr", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query(f"WITH {_FRAMES} SELECT crop_id, round(avg(score), 6) AS score FROM emitted GROUP BY crop_id")
def ctc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctc.text(_emitted(spark, sf_dir)).select("crop_id", F.round("score", 6).alias("score"))


_BLOCKS = f"""{LINES_SQL}, blocks AS (
  SELECT image_id, line_id, n, CAST(coalesce(sum(n + 1) OVER (PARTITION BY image_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (SELECT image_id, line_id, length(trim(text)) AS n FROM lines)),
bounds AS (SELECT image_id, line_id, s, s + n AS e FROM blocks), points AS (SELECT image_id, k, (k * 97 + image_id) % 500 AS p FROM (SELECT DISTINCT image_id FROM lines), range(4) r(k))"""


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.trim("text")).cast("long")
    rows = text_lines(spark, sf_dir).select("image_id", "line_id", n.alias("n"))
    before = Window.partitionBy("image_id").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    s = F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))
    return rows.select("image_id", "line_id", s.alias("s"), (s + F.col("n")).alias("e"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"))
    return docs.select("image_id", F.explode(F.array(*(F.lit(k).cast("long") for k in range(4)))).alias("k")).withColumn("p", (F.col("k") * 97 + F.col("image_id")) % 500)


@query(f"WITH {_BLOCKS} SELECT image_id, CAST(line_id AS INTEGER) AS line_id, s, e FROM bounds")
def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each block starts and ends in its image's joined text."""
    return _bounds(spark, sf_dir)


@query(f"WITH {_BLOCKS} SELECT p.image_id, p.k, CAST(b.line_id AS INTEGER) AS line_id, least(p.p + 60, b.e) - greatest(p.p, b.s) AS overlap FROM points p JOIN bounds b ON p.image_id = b.image_id AND least(p.p + 60, b.e) - greatest(p.p, b.s) > 0")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each 60-character range lies in each block; ranges and blocks meet within one image."""
    shared = F.least(F.col("p") + 60, F.col("e")) - F.greatest("p", "s")
    met = _points(spark, sf_dir).join(_bounds(spark, sf_dir), "image_id").withColumn("overlap", shared)
    return met.where("overlap > 0").select("image_id", "k", "line_id", "overlap")


def _around(spark: SparkSession, sf_dir: str, pick) -> DataFrame:
    """For every point one block: pick gives the aggregate over its image's blocks."""
    met = _points(spark, sf_dir).join(_bounds(spark, sf_dir), "image_id", "left")
    return met.groupBy("image_id", "k").agg(pick.alias("line_id"))


@query(f"WITH {_BLOCKS} SELECT p.image_id, p.k, CAST(min(CASE WHEN b.s <= p.p AND p.p < b.e THEN b.line_id END) AS INTEGER) AS line_id FROM points p LEFT JOIN bounds b ON p.image_id = b.image_id GROUP BY ALL")
def point_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block that holds the point."""
    return _around(spark, sf_dir, F.min(F.when((F.col("s") <= F.col("p")) & (F.col("p") < F.col("e")), F.col("line_id"))))


@query(f"WITH {_BLOCKS} SELECT p.image_id, p.k, CAST(max(CASE WHEN b.e <= p.p THEN b.line_id END) AS INTEGER) AS line_id FROM points p LEFT JOIN bounds b ON p.image_id = b.image_id GROUP BY ALL")
def asof_prev_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last block that ends at or before the point."""
    return _around(spark, sf_dir, F.max(F.when(F.col("e") <= F.col("p"), F.col("line_id"))))


@query(f"WITH {_BLOCKS} SELECT p.image_id, p.k, CAST(min(CASE WHEN b.s >= p.p THEN b.line_id END) AS INTEGER) AS line_id FROM points p LEFT JOIN bounds b ON p.image_id = b.image_id GROUP BY ALL")
def asof_next_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block that starts at or after the point."""
    return _around(spark, sf_dir, F.min(F.when(F.col("s") >= F.col("p"), F.col("line_id"))))


@query(f"""WITH {_BLOCKS}, o AS (SELECT p.image_id, p.k, b.line_id, least(p.p + 60, b.e) - greatest(p.p, b.s) AS overlap, 37 AS len FROM points p JOIN bounds b ON p.image_id = b.image_id AND least(p.p + 60, b.e) - greatest(p.p, b.s) > 0),
r AS (SELECT *, round_even(len * overlap / CAST(sum(overlap) OVER (PARTITION BY image_id, k) AS DOUBLE), 0) AS n, row_number() OVER (PARTITION BY image_id, k ORDER BY line_id DESC) AS last FROM o)
SELECT image_id, k, CAST(line_id AS INTEGER) AS line_id, CAST(CASE WHEN last = 1 THEN len - coalesce(sum(n) OVER (PARTITION BY image_id, k ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE n END AS BIGINT) AS n FROM r""")
def proportional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """37 characters over the blocks of a range by overlap: halves to even, the rest to the last block."""
    o = interval_overlap_join(spark, sf_dir)
    one = Window.partitionBy("image_id", "k")
    n = F.bround(37 * F.col("overlap") / F.sum("overlap").over(one), 0)
    o = o.withColumn("n", n).withColumn("last", F.row_number().over(one.orderBy(F.desc("line_id"))))
    before = F.coalesce(F.sum("n").over(one.orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return o.withColumn("before", before).select("image_id", "k", "line_id", F.when(F.col("last") == 1, 37 - F.col("before")).otherwise(F.col("n")).cast("long").alias("n"))


@query()
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected lines of benchmark texts merged with a differing plain text."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("image_id"), "text")
    blocks = rows.select("image_id", F.posexplode(F.split("text", "(?<=[,.]) ")).alias("block_no", "text"))
    plain = rows.select("image_id", F.regexp_replace(F.regexp_replace("text", " the ", " thhe + "), "(?<=[,.]) ", "\n").alias("text"))
    return align.hybrid(blocks, plain)


@query()
def hybrid_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged lines, mended by the documents' word frequencies."""
    merged = hybrid_merge(spark, sf_dir).select(F.struct("image_id", "block_no").alias("id"), "text")
    done = restore.restored(merged, restore.frequencies(table(spark, sf_dir, "documents")))
    return done.select("id.image_id", "id.block_no", "text")
