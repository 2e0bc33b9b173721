"""Queries over a model catalog whose files, models, users and requests are rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.plans.registry import query
from glintframe.sources.tables import literal, table

#: In the order in which they are fetched.
CATEGORIES = [("clip", True), ("ocr_server", True), ("ocr_mobile", True), ("face", True), ("stt", False)]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


# Parts stand for the files of models: parts of one brand and size share files, every third size is an archive, most files are there.
_BASE = f"""{_values("categories", "category, enabled", CATEGORIES)},
parts AS (SELECT lower(replace(p_brand, '#', '-')) || '/' || p_size AS folder, p_partkey % 50 || '.onnx' AS file, p_size, p_partkey FROM part),
manifest AS (SELECT DISTINCT folder || '/' || file AS rel_path, 'https://files.example.net/' || folder || CASE WHEN p_size % 3 = 0 THEN '.tar#' ELSE '/' END || file AS url,
  ['clip', 'ocr_server', 'ocr_mobile', 'face', 'stt'][p_partkey % 5 + 1] AS category FROM parts),
present AS (SELECT DISTINCT folder || '/' || file AS rel_path FROM parts WHERE (p_size + p_partkey % 50) % 4 <> 0 OR p_partkey % 5 = 0)"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, files that are there, and categories."""
    c = F.col
    parts = table(spark, sf_dir, "part").select(F.concat_ws("/", F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), "p_size").alias("folder"), F.concat(c("p_partkey") % 50, F.lit(".onnx")).alias("file"), "p_size", "p_partkey")
    path = F.concat_ws("/", "folder", "file").alias("rel_path")
    url = F.concat(F.lit("https://files.example.net/"), "folder", F.when(c("p_size") % 3 == 0, ".tar#").otherwise("/"), "file")
    category = F.get(F.array(*(F.lit(name) for name, _ in CATEGORIES)), (c("p_partkey") % 5).cast("int"))
    manifest = parts.select(path, url.alias("url"), category.alias("category")).distinct()
    present = parts.where(((c("p_size") + c("p_partkey") % 50) % 4 != 0) | (c("p_partkey") % 5 == 0)).select(path).distinct()
    return manifest, present, literal(spark, "category, enabled", CATEGORIES)


_ORDERED = _values("ordered", "category, ord", [(c, k) for k, (c, enabled) in enumerate(CATEGORIES) if enabled])


@query(f"WITH {_BASE}, {_ORDERED}, m AS (SELECT m.rel_path, m.url, min(o.ord) AS ord FROM manifest m JOIN ordered o ON o.category = m.category WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.rel_path = m.rel_path) GROUP BY ALL) SELECT split_part(url, '#', 1) AS download, count(*) AS files, contains(min(url), '#') AS archive, CAST(min(ord) AS INTEGER) AS step FROM m GROUP BY 1")
def missing_model_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be downloaded: files of enabled categories that are not there; an archive once for all its members, in the step of the first category that needs it."""
    manifest, present, _ = _tables(spark, sf_dir)
    ordered = literal(spark, "category, ord", [(c, k) for k, (c, enabled) in enumerate(CATEGORIES) if enabled])
    missing = manifest.join(ordered, "category").join(present, "rel_path", "left_anti").groupBy("rel_path", "url").agg(F.min("ord").alias("ord"))
    return missing.groupBy(F.split_part("url", F.lit("#"), F.lit(1)).alias("download")).agg(F.count("*").alias("files"), F.contains(F.min("url"), F.lit("#")).alias("archive"), F.min("ord").alias("step"))


@query(f"WITH {_BASE}, f AS (SELECT m.category, p.rel_path IS NOT NULL AS here FROM manifest m LEFT JOIN present p ON p.rel_path = m.rel_path), r AS (SELECT c.category, c.enabled, coalesce(bool_and(f.here), true) AS ready FROM categories c LEFT JOIN f ON f.category = c.category GROUP BY ALL) SELECT category, enabled, ready, category NOT IN ('clip') AS blocks, bool_or(ready AND enabled) OVER () AS any_ready FROM r")
def models_ready_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all files of a category are there (true without any), and whether any enabled one is ready."""
    manifest, present, categories = _tables(spark, sf_dir)
    files = manifest.join(present.withColumn("here", F.lit(True)), "rel_path", "left").select("category", F.coalesce("here", F.lit(False)).alias("here"))
    ready = categories.join(files, "category", "left").groupBy("category", "enabled").agg(F.coalesce(F.bool_and("here"), F.lit(True)).alias("ready"))
    whole = Window.partitionBy()
    return ready.withColumn("blocks", ~F.col("category").isin("clip")).withColumn("any_ready", F.bool_or(F.col("ready") & F.col("enabled")).over(whole))


# Names of a component's file, the best first.
PREFERRED = [(0, "-epoch-99-avg-1.int8.onnx"), (1, ".int8.onnx"), (2, "-epoch-99-avg-1.onnx"), (3, ".onnx")]
# Suppliers stand for speech models, every other one a streaming one; some lines of orders for files that are there.
_NAMES = ["tokens.txt", "model.int8.onnx", *(part + suffix for part in ("encoder", "decoder", "joiner") for _, suffix in PREFERRED)]
_STT = f"""{_values("preferred", "rank, suffix", PREFERRED)}, models AS (SELECT 's' || s_suppkey AS id, 'd' || s_suppkey AS dir, s_suppkey % 2 = 1 AS streaming FROM supplier),
files AS (SELECT DISTINCT 'd' || l_suppkey || '/' || ['{"', '".join(_NAMES)}'][(l_partkey + l_linenumber * 5) % {len(_NAMES)} + 1] AS path FROM lineitem WHERE l_quantity <= 2)"""


def _models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Speech models, preferred file names, files that are there."""
    c = F.col
    models = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("d"), "s_suppkey").alias("dir"), (c("s_suppkey") % 2 == 1).alias("streaming"))
    name = F.get(F.array(*(F.lit(n) for n in _NAMES)), ((c("l_partkey") + c("l_linenumber") * 5) % len(_NAMES)).cast("int"))
    files = table(spark, sf_dir, "lineitem").where("l_quantity <= 2").select(F.concat(F.lit("d"), "l_suppkey", F.lit("/"), name).alias("path")).distinct()
    return models, literal(spark, "rank, suffix", PREFERRED), files


@query(f"""WITH {_STT}, need AS (SELECT id, dir, 'tokens' AS part, dir || '/tokens.txt' AS path FROM models UNION ALL SELECT id, dir, 'model', dir || '/model.int8.onnx' FROM models WHERE NOT streaming
  UNION ALL SELECT id, dir, c.part, dir || '/' || c.part || p.suffix FROM models, (VALUES ('encoder'), ('decoder'), ('joiner')) c(part), preferred p WHERE streaming),
found AS (SELECT n.id, n.part, bool_or(f.path IS NOT NULL) AS here FROM need n LEFT JOIN files f ON f.path = n.path GROUP BY ALL) SELECT id, bool_and(here) AS ready FROM found GROUP BY id""")
def stt_model_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speech model is ready with its tokens and either its one file or each of its three parts under some name."""
    models, preferred, files = _models(spark, sf_dir)
    part = literal(spark, "part", [("encoder",), ("decoder",), ("joiner",)])
    path = lambda *p: F.concat(F.col("dir"), F.lit("/"), *p).alias("path")
    need = models.select("id", F.lit("tokens").alias("part"), path(F.lit("tokens.txt")))
    need = need.union(models.where("not streaming").select("id", F.lit("model"), path(F.lit("model.int8.onnx"))))
    need = need.union(models.where("streaming").join(part).join(preferred).select("id", "part", path(F.col("part"), F.col("suffix"))))
    found = need.join(files.withColumn("here", F.lit(True)), "path", "left").groupBy("id", "part").agg(F.bool_or(F.coalesce("here", F.lit(False))).alias("here"))
    return found.groupBy("id").agg(F.bool_and("here").alias("ready"))


@query(f"WITH {_STT} SELECT m.id, c.part, arg_min(f.path, p.rank) AS path FROM models m, (VALUES ('encoder'), ('decoder'), ('joiner')) c(part), preferred p JOIN files f ON f.path = m.dir || '/' || c.part || p.suffix GROUP BY ALL")
def first_match_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each component's preferred file among those there."""
    models, preferred, files = _models(spark, sf_dir)
    part = literal(spark, "part", [("encoder",), ("decoder",), ("joiner",)])
    names = part.join(preferred)  # twelve names
    named = models.join(F.broadcast(names)).withColumn("path", F.concat("dir", F.lit("/"), "part", "suffix"))
    return named.join(files, "path").groupBy("id", "part").agg(F.min_by("path", "rank").alias("path"))


_OCR = """known AS (SELECT p_partkey AS ord, 'ocr-' || p_partkey AS id, p_name AS name FROM part), live AS (SELECT DISTINCT 'ocr-' || l_partkey AS id FROM lineitem WHERE l_quantity = 50)"""


@query(f"WITH {_OCR} SELECT ord, k.id, name, l.id IS NOT NULL AS loaded FROM known k LEFT JOIN live l ON l.id = k.id")
def ocr_model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for models; those of some sales are loaded."""
    live = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.concat(F.lit("ocr-"), "l_partkey").alias("id")).distinct().withColumn("live", F.lit(True))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.concat(F.lit("ocr-"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return known.join(live, "id", "left").select("ord", "id", "name", F.coalesce("live", F.lit(False)).alias("loaded"))


# Events stand for what models report.
_HEALTH = """h AS (SELECT event_id AS id, user_id AS node, event_type = 'purchase' AS loaded, CASE event_type WHEN 'view' THEN 'loading' WHEN 'click' THEN 'downloading' WHEN 'signup' THEN 'done' END AS phase,
  CASE WHEN event_type = 'error' THEN 'no file ' || event_id END AS error, event_id % 2 = 0 AS slow FROM events)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    phase = F.when(kind == "view", "loading").when(kind == "click", "downloading").when(kind == "signup", "done")
    error = F.when(kind == "error", F.concat(F.lit("no file "), "event_id"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("node"), (kind == "purchase").alias("loaded"), phase.alias("phase"), error.alias("error"), (F.col("event_id") % 2 == 0).alias("slow"))


@query(f"WITH {_HEALTH} SELECT id, CASE WHEN loaded THEN 'ready' WHEN phase IN ('downloading', 'loading') THEN phase WHEN error IS NOT NULL THEN 'error' ELSE 'not_loaded' END AS status, CASE WHEN loaded THEN 'already_loaded' WHEN phase IN ('downloading', 'loading') THEN 'in_progress' WHEN slow THEN 'started' ELSE 'loaded' END AS reply FROM h")
def model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by precedence loaded, busy, error, not loaded; and the reply to a request to load."""
    c = F.col
    busy = c("phase").isin("downloading", "loading")
    status = F.when(c("loaded"), "ready").when(busy, c("phase")).when(c("error").isNotNull(), "error").otherwise("not_loaded")
    reply = F.when(c("loaded"), "already_loaded").when(busy, "in_progress").when(c("slow"), "started").otherwise("loaded")
    return _health(spark, sf_dir).select("id", status.alias("status"), reply.alias("reply"))


# Parts stand for localized texts, customers for users with two preferred languages and a section each.
_TAGS, _PREFS = ["en-US", "zh-CN", "de-DE", "pt-BR"], ["fr", "zh-TW", "de-DE", "ZH-CN", "en_GB", "pt_PT", "_x", ""]
_LOC = f"""loc AS (SELECT ['{"', '".join(_TAGS)}'][p_partkey % 4 + 1] AS tag, CASE WHEN p_partkey % 3 = 0 THEN 'section' ELSE 'model' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'sec' || p_size % 9 ELSE 'mod' || p_size % 22 END AS key,
  min(CASE WHEN p_partkey % 7 = 0 THEN 'stt.' || p_name ELSE p_name END) AS text, min(p_brand) AS description FROM part GROUP BY ALL),
cat AS (SELECT DISTINCT p_size % 8 AS s_ord, 'sec' || p_size % 8 AS section, p_size % 20 AS m_ord, 'mod' || p_size % 20 AS model, 'built-in ' || p_size % 20 AS builtin FROM part),
prefs AS (SELECT c_custkey AS who, 'sec' || c_custkey % 8 AS wants, o AS ord, ['{"', '".join(_PREFS)}'][(c_nationkey * (o + 1) + o) % {len(_PREFS)} + 1] AS pref FROM customer, (VALUES (0), (1)) v(o))"""
_PICK = """tags AS (SELECT DISTINCT tag FROM loc), whos AS (SELECT DISTINCT who, wants FROM prefs),
picks AS (SELECT p.who, arg_min(t.tag, p.ord * 2 + CASE WHEN t.tag = p.pref THEN 0 ELSE 1 END) AS tag FROM prefs p JOIN tags t ON t.tag = p.pref OR (split_part(replace(p.pref, '_', '-'), '-', 1) <> '' AND starts_with(t.tag, split_part(replace(p.pref, '_', '-'), '-', 1))) GROUP BY p.who),
chosen AS (SELECT w.who, w.wants, coalesce(p.tag, 'en-US') AS tag FROM whos w LEFT JOIN picks p ON p.who = w.who)"""


@query(f"""WITH {_LOC}, {_PICK}
SELECT c.who, c.tag, k.s_ord, k.section, coalesce(s.text, k.section) AS title, coalesce(s.description, '') AS about, k.m_ord, k.model, CASE WHEN coalesce(m.text, k.model) = k.model OR starts_with(coalesce(m.text, k.model), 'stt.') THEN k.builtin ELSE m.text END AS name
FROM chosen c JOIN cat k ON k.section = c.wants LEFT JOIN loc s ON s.tag = c.tag AND s.kind = 'section' AND s.key = k.section LEFT JOIN loc m ON m.tag = c.tag AND m.kind = 'model' AND m.key = k.model""")
def catalog_localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section that each user wants, in their language: an exact tag, else the language, by preference; else English; else keys and built-in names."""
    c, part = F.col, table(spark, sf_dir, "part")
    one_of = lambda names, at: F.get(F.array(*(F.lit(n) for n in names)), at.cast("int"))
    mod = lambda name, size: F.concat(F.lit(name), c("p_size") % size)
    third = c("p_partkey") % 3 == 0
    loc = part.groupBy(one_of(_TAGS, c("p_partkey") % 4).alias("tag"), F.when(third, "section").otherwise("model").alias("kind"), F.when(third, mod("sec", 9)).otherwise(mod("mod", 22)).alias("key"))
    loc = loc.agg(F.min(F.when(c("p_partkey") % 7 == 0, F.concat(F.lit("stt."), "p_name")).otherwise(c("p_name"))).alias("text"), F.min("p_brand").alias("description"))
    cat = part.select((c("p_size") % 8).alias("s_ord"), mod("sec", 8).alias("section"), (c("p_size") % 20).alias("m_ord"), mod("mod", 20).alias("model"), mod("built-in ", 20).alias("builtin")).distinct()
    prefs = table(spark, sf_dir, "customer").select(c("c_custkey").alias("who"), F.concat(F.lit("sec"), c("c_custkey") % 8).alias("wants"), "c_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"))
    prefs = prefs.select("who", "wants", "ord", one_of(_PREFS, (c("c_nationkey") * (c("ord") + 1) + c("ord")) % len(_PREFS)).alias("pref"))
    tags = loc.select("tag").distinct()
    lang = F.split_part(F.replace("pref", F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    fits = prefs.join(F.broadcast(tags), (F.col("tag") == F.col("pref")) | ((lang != "") & F.startswith("tag", lang)))
    pick = fits.groupBy("who").agg(F.min_by("tag", F.col("ord") * 2 + F.when(F.col("tag") == F.col("pref"), 0).otherwise(1)).alias("tag"))
    chosen = prefs.select("who", "wants").distinct().join(pick, "who", "left").select("who", c("wants").alias("section"), F.coalesce("tag", F.lit("en-US")).alias("tag"))
    named = lambda kind, key, text, about: loc.where(F.col("kind") == kind).select("tag", F.col("key").alias(key), F.col("text").alias(text), F.col("description").alias(about))
    rows = chosen.join(cat, "section").join(named("section", "section", "s_text", "s_about"), ["tag", "section"], "left").join(named("model", "model", "m_text", "m_about"), ["tag", "model"], "left")
    name = F.coalesce("m_text", "model")
    shown = F.when((name == F.col("model")) | F.startswith(name, F.lit("stt.")), F.col("builtin")).otherwise(name)
    return rows.select("who", "tag", "s_ord", "section", F.coalesce("s_text", "section").alias("title"), F.coalesce("s_about", F.lit("")).alias("about"), "m_ord", "model", shown.alias("name"))


# Orders stand for sections, their lines for models.
_SECTIONS = """sections AS (SELECT o_orderkey AS ord, 'section ' || o_orderkey AS section FROM orders),
models AS (SELECT DISTINCT 'section ' || l_orderkey AS section, l_linenumber * 10000000 + l_partkey AS place, 'part ' || l_partkey AS id, l_partkey % 7 <> 0 AS enabled, l_partkey % 2 = 0 AS ready FROM lineitem)"""


@query(f"""WITH {_SECTIONS}, m AS (SELECT section, to_json(list({{'id': id, 'state': CASE WHEN ready THEN 'ready' ELSE 'not_downloaded' END, 'action': CASE WHEN ready THEN 'remove' ELSE 'download' END}} ORDER BY place)) AS models, count(*) AS n FROM models WHERE enabled GROUP BY section)
SELECT ord, s.section, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(CAST(m.models AS VARCHAR), '[]') AS models FROM sections s LEFT JOIN m ON m.section = s.section""")
def catalog_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their enabled models nested, each with its state and what can be done; a section without any stays, empty."""
    ready = lambda yes, no: F.when(F.col("ready"), yes).otherwise(no)
    one = F.struct("place", F.struct("id", ready("ready", "not_downloaded").alias("state"), ready("remove", "download").alias("action")).alias("model"))
    part = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("section "), "l_orderkey").alias("section"), (F.col("l_linenumber") * 10_000_000 + part).alias("place"), F.concat(F.lit("part "), part).alias("id"), (part % 7 != 0).alias("enabled"), (part % 2 == 0).alias("ready"))
    models = lines.distinct().where("enabled").groupBy("section").agg(F.array_sort(F.collect_list(one)).alias("l"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("section "), "o_orderkey").alias("section")).join(models, "section", "left")
    nested = F.coalesce(F.to_json(F.transform("l", lambda r: r["model"])), F.lit("[]"))
    return rows.select("ord", "section", F.coalesce(F.nullif(F.size("l"), F.lit(-1)), F.lit(0)).cast("long").alias("n"), nested.alias("models"))


@query(f"""WITH {_HEALTH} SELECT node, bool_or(loaded) AS any_loaded, '{{' || string_agg('"' || id || '":' || CAST(json_object('loaded', loaded, 'device', CASE WHEN loaded THEN 'cpu' ELSE 'none' END, 'error', coalesce(error, '')) AS VARCHAR), ',' ORDER BY id) || '}}' AS models FROM h GROUP BY node""")
def health_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a node: a map from each of its models to whether it is loaded, where, and what went wrong."""
    state = F.struct("loaded", F.when(F.col("loaded"), "cpu").otherwise("none").alias("device"), F.coalesce("error", F.lit("")).alias("error"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("id", state.alias("state")))), lambda e: F.struct(e["id"].cast("string").alias("id"), e["state"].alias("state")))
    return _health(spark, sf_dir).groupBy("node").agg(F.bool_or("loaded").alias("any_loaded"), F.to_json(F.map_from_entries(entries)).alias("models"))


# Pages' addresses stand for folders, with one of seven ends each.
_ENDS = ["/perception", "/ai-models", "/perception/", "/my-perception", "/perception/x", "", "/ai-models//"]


@query(f"WITH p AS (SELECT page_id, '/' || regexp_extract(url, '://(.*)', 1) || ['{"', '".join(_ENDS)}'][page_id % 7 + 1] AS path FROM pages UNION ALL SELECT -1 - page_id, ['/perception', 'models', '/ai-models/'][page_id % 3 + 1] FROM pages) SELECT page_id, path, CASE WHEN regexp_matches(rtrim(path, '/'), '/(perception|ai-models)$') THEN CASE WHEN regexp_matches(path, '^/[^/]+/*$') THEN '/' ELSE regexp_replace(rtrim(path, '/'), '/+[^/]*$', '') END ELSE path END AS root FROM p")
def models_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder above one whose last part is one of the two names; any other path as it is."""
    # The two names.
    pages = table(spark, sf_dir, "pages")
    end = lambda ends: F.get(F.array(*(F.lit(e) for e in ends)), (F.col("page_id") % len(ends)).cast("int"))
    long = pages.select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "://(.*)", 1), end(_ENDS)).alias("path"))
    paths = long.unionAll(pages.select(-1 - F.col("page_id"), end(["/perception", "models", "/ai-models/"])))
    return paths.select("page_id", "path", F.when(F.rlike("path", F.lit("/(perception|ai-models)/*$")), F.regexp_replace(F.regexp_replace("path", "/+[^/]+/*$", ""), "^$", "/")).otherwise(F.col("path")).alias("root"))


# The two ids that have a route of their own. Documents stand for requests.
_MOBILE, _SIDECAR = "ocr.pp-ocrv5-mobile", "ocr.got-ocr-2"
_IDS = f"""ids AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '{_MOBILE}' WHEN 1 THEN '{_SIDECAR}' WHEN 2 THEN 'ocr.' || source WHEN 3 THEN 'clip.' || lang WHEN 4 THEN 'face.x.' || doc_id
  WHEN 5 THEN 'stt.' || source || '.' || lang WHEN 6 THEN 'sidecar.a' WHEN 7 THEN 'no' || source ELSE 'what.' || lang END AS id FROM documents)"""


@query(f"WITH {_IDS}, p AS (SELECT doc_id, id, split_part(id, '.', 1) AS s, substr(id, strpos(id, '.') + 1) AS slug FROM ids) SELECT doc_id, id, CASE WHEN NOT contains(id, '.') THEN 'unknown' WHEN id = '{_MOBILE}' THEN 'ocr_mobile' WHEN id = '{_SIDECAR}' THEN 'sidecar' WHEN s = 'ocr' THEN 'ocr_server' WHEN s IN ('clip', 'face', 'stt', 'sidecar') THEN s ELSE 'unknown' END AS route, CASE WHEN contains(id, '.') THEN slug END AS slug FROM p")
def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which part serves a model id `section.slug`; the first dot parts them."""
    kind = F.col("doc_id") % 9
    some = lambda *p: F.concat(*(F.col(x) if x in ("source", "lang", "doc_id") else F.lit(x) for x in p))
    asked = F.when(kind == 0, _MOBILE).when(kind == 1, _SIDECAR).when(kind == 2, some("ocr.", "source")).when(kind == 3, some("clip.", "lang")).when(kind == 4, some("face.x.", "doc_id"))
    asked = asked.when(kind == 5, some("stt.", "source", ".", "lang")).when(kind == 6, "sidecar.a").when(kind == 7, some("no", "source")).otherwise(some("what.", "lang"))
    ids = table(spark, sf_dir, "documents").select("doc_id", asked.alias("id"))
    dotted = F.contains("id", F.lit("."))
    s, slug = F.substring_index("id", ".", 1), F.substring(F.col("id"), F.instr("id", ".") + 1, F.length("id"))
    route = F.when(~dotted, "unknown").when(F.col("id") == _MOBILE, "ocr_mobile").when(F.col("id") == _SIDECAR, "sidecar").when(s == "ocr", "ocr_server").when(s.isin("clip", "face", "stt", "sidecar"), s).otherwise("unknown")
    return ids.select("doc_id", "id", route.alias("route"), F.when(dotted, slug).alias("slug"))


# Turns of conversations stand for messages, with one of seven ends each.
_WORDS = ["OCR is Disabled", "model not found", "file MISSING: x not ready", "Model not ready", "tokens not present", "boom", "disabled and not found"]


@query(f"WITH e AS (SELECT conv_id, turn, text || ' ' || ['{"', '".join(_WORDS)}'][(conv_id + turn) % 7 + 1] AS message FROM conversations) SELECT conv_id, turn, CASE WHEN contains(lower(message), 'disabled') THEN 'disabled' WHEN contains(lower(message), 'not found') OR contains(lower(message), 'missing') THEN 'not_found' WHEN contains(lower(message), 'not ready') OR contains(lower(message), 'not present') THEN 'not_ready' ELSE 'internal' END AS kind FROM e")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of errors by words of their message; the first rule that fits."""
    has = lambda *w: F.rlike(F.lower("message"), F.lit("|".join(w)))
    kind = F.when(has("disabled"), "disabled").when(has("not found", "missing"), "not_found").when(has("not ready", "not present"), "not_ready").otherwise("internal")
    end = F.get(F.array(*(F.lit(w) for w in _WORDS)), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", end).alias("message"))
    return messages.select("conv_id", "turn", kind.alias("kind"))


@query("""WITH known AS (SELECT n_nationkey AS ord, lower(n_name) AS id, n_name AS name FROM nation), asked AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 3 = 0 THEN 'x' || c_custkey ELSE lower(n_name) END AS id FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT n, a.id, coalesce(k.name, a.id) AS name, CASE WHEN k.id IS NULL THEN 404 ELSE 200 END AS code, CASE WHEN k.id IS NULL THEN (SELECT string_agg(id, ', ' ORDER BY ord) FROM known) END AS known FROM asked a LEFT JOIN known k ON k.id = a.id""")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by id; an unknown one gives 404 and the list of those known."""
    nations = table(spark, sf_dir, "nation")
    known = nations.select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("id"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    asked = customers.select(F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), "c_custkey")).otherwise(F.lower("n_name")).alias("id"))
    every = known.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda r: r["id"]), ", ").alias("every"))
    rows = asked.join(known, "id", "left").join(F.broadcast(every))
    return rows.select("n", "id", F.coalesce("name", "id").alias("name"), F.when(F.col("name").isNull(), 404).otherwise(200).alias("code"), F.when(F.col("name").isNull(), F.col("every")).alias("known"))


@query(f"WITH {_BASE}, ready AS (SELECT rel_path FROM present) SELECT DISTINCT rel_path FROM manifest EXCEPT SELECT rel_path FROM ready")
def ready_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, present, _ = _tables(spark, sf_dir)
    return manifest.select("rel_path").subtract(present)
