"""Queries over embeddings: classification, similarity, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.functions import vectors as V
from glintframe.operators import classify
from glintframe.plans.registry import query
from glintframe.sources.tables import table

_TAX = "tax AS (SELECT label AS cat_idx, vec_id AS sub_idx, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id < 100)"
_BEST = f"""{_TAX},
sims AS (
  SELECT q.vec_id, t.cat_idx, t.sub_idx, list_dot_product(CAST(q.embedding AS DOUBLE[]), t.v) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(t.v, t.v))) AS sim
  FROM embeddings q, tax t WHERE q.vec_id >= 100),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, cat_idx ORDER BY sim DESC, sub_idx) AS k FROM sims) WHERE k = 1),
soft AS (
  SELECT vec_id, cat_idx, sub_idx, sim, exp(sim * 100 - max(sim * 100) OVER (PARTITION BY vec_id)) AS w FROM best),
probs AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS prob FROM soft)"""


def _taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id < 100").select(F.col("label").alias("cat_idx"), F.col("vec_id").alias("sub_idx"), F.col("embedding").alias("v"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id >= 100").select("vec_id", F.col("embedding").alias("v"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.best_prompts(_queries(spark, sf_dir), _taxonomy(spark, sf_dir))


@query(f"WITH {_BEST} SELECT vec_id, cat_idx, sub_idx, round(prob, 6) AS prob, CAST(k2 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, cat_idx) AS k2 FROM probs WHERE prob >= 0.02) WHERE k2 <= 5")
def zero_shot_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = classify.top_tags(classify.softmax(_best(spark, sf_dir)))
    return tags.select("vec_id", "cat_idx", "sub_idx", F.round("prob", 6).alias("prob"), "rank")


@query(f"WITH {_BEST} SELECT vec_id, cat_idx, sub_idx, round(sim, 6) AS sim FROM best")
def category_best_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("vec_id", "cat_idx", "sub_idx", F.round("sim", 6).alias("sim"))


@query(f"WITH {_BEST} SELECT vec_id, cat_idx, round(prob, 6) AS prob FROM probs")
def category_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.softmax(_best(spark, sf_dir)).select("vec_id", "cat_idx", F.round("prob", 6).alias("prob"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cosine FROM p WHERE b IS NOT NULL""")
def vector_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next one of its label: rows are numbered by ranges, so a label of any size is many tasks."""
    from glintframe.sources.lines import numbered

    rows = numbered(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id")
    after = rows.select((F.col("number") - 1).alias("number"), F.col("label").alias("same"), F.col("embedding").alias("b"))
    pairs = rows.join(after, "number").where(F.col("label").eqNullSafe(F.col("same")) & F.col("b").isNotNull())
    return pairs.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


@query("""WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)
SELECT vec_id, round(n, 6) AS norm, round(CASE WHEN n = 0 THEN list_sum(v) ELSE list_sum(list_transform(v, lambda x: x / n)) END, 6) AS checksum FROM n""")
def vector_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.total(V.l2_normalized(v)), 6).alias("checksum"))


@query(f"WITH {_BEST}, r AS (SELECT vec_id, sub_idx, sim, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, sub_idx) AS rank FROM sims) SELECT vec_id, sub_idx, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def vector_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar prompts of every vector: every prompt a category of its own."""
    prompts = _taxonomy(spark, sf_dir).withColumn("cat_idx", F.col("sub_idx").cast("int"))
    best = classify.best_prompts(_queries(spark, sf_dir), prompts)
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "sub_idx"))
    return best.withColumn("rank", rank).where("rank <= 3").select("vec_id", "sub_idx", F.round("sim", 6).alias("sim"), "rank")


@query("SELECT label AS cat_idx, vec_id AS sub_idx, concat('cat', label) AS category, concat('一张', 'sub', vec_id, '的照片') AS prompt FROM embeddings WHERE vec_id < 100")
def taxonomy_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 100")
    return rows.select(F.col("label").alias("cat_idx"), F.col("vec_id").alias("sub_idx"), F.format_string("cat%s", "label").alias("category"), F.format_string("一张sub%s的照片", "vec_id").alias("prompt"))


@query("""WITH c AS (SELECT p_brand AS name, min(p_type) AS icon, list(p_name ORDER BY p_partkey) AS subs, row_number() OVER (ORDER BY p_brand, p_size) - 1 AS id FROM part GROUP BY p_brand, p_size),
u AS (SELECT id, name, icon, unnest(range(len(subs))) AS sub_idx, unnest(subs) AS sub FROM c)
SELECT id AS cat_idx, CAST(sub_idx AS INTEGER) AS sub_idx, name AS category, icon, sub, '一张' || sub || '的照片' AS prompt FROM u""")
def taxonomy_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size as a category's line of JSON; numbered, parsed and turned into prompts."""
    from glintframe.sources.lines import numbered
    from glintframe.sources.taxonomy import prompts

    subs = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda r: r["p_name"])
    lines = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.to_json(F.struct(F.first("p_brand").alias("name"), F.min("p_type").alias("icon"), subs.alias("subs"))).alias("line"))
    return prompts(numbered(lines, "p_brand", "p_size").select(F.col("number").alias("id"), "line"))


@query("SELECT md5(string_agg(concat(label, ':', vec_id), ';' ORDER BY label, vec_id)) AS fingerprint, count(*) AS prompts FROM embeddings WHERE vec_id < 100")
def taxonomy_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of the ordered taxonomy, to tell when derived data is stale; the taxonomy is a bounded dimension."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id < 100")
    ordered = F.array_sort(F.collect_list(F.struct("label", "vec_id")))
    return rows.agg(F.md5(F.array_join(F.transform(ordered, lambda r: F.concat(r["label"].cast("string"), F.lit(":"), r["vec_id"].cast("string"))), ";")).alias("fingerprint"), F.count("*").alias("prompts"))
