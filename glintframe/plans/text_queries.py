"""Queries over texts: normalization, tokens, sentences, spacing and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.functions import text as X
from glintframe.operators import restore as R
from glintframe.operators import wordpiece as W
from glintframe.plans.registry import query
from glintframe.sources.lines import framed, numbered
from glintframe.sources.tables import literal, table

# Characters that the tables lack, put around every text.
_ODD = "\u0001 �\u0085中文éx"
_ODD_SQL = "chr(1) || chr(160) || chr(65533) || chr(133) || '中文e' || chr(769) || 'x'"
_DOCS_SQL = f"SELECT doc_id, {_ODD_SQL} || text AS text FROM documents"
_CONTROL_SQL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]"
_SPACES_SQL = r"[\t\n\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '{_CONTROL_SQL}', '', 'g'), '{_SPACES_SQL}', ' ', 'g')"


def _cjk_sql(t: str) -> str:
    return f"regexp_replace({t}, '{X.CJK}', ' \\1 ', 'g')"


def _marks_sql(t: str) -> str:
    return f"regexp_replace({t}, '{X.MARKS}', '', 'g')"


_TOKEN_SQL = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def _odd_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(_ODD), "text").alias("text"))


@query(f"SELECT doc_id, md5({_clean_sql('text')}) AS cleaned FROM ({_DOCS_SQL})")
def tok_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_docs(spark, sf_dir).select("doc_id", F.md5(X.cleaned(F.col("text"))).alias("cleaned"))


@query(f"SELECT doc_id, md5({_cjk_sql('text')}) AS spaced FROM ({_DOCS_SQL})")
def tok_cjk_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_docs(spark, sf_dir).select("doc_id", F.md5(X.cjk_spaced(F.col("text"))).alias("spaced"))


@query(f"SELECT doc_id, md5({_marks_sql('text')}) AS stripped FROM ({_DOCS_SQL})")
def tok_strip_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _odd_docs(spark, sf_dir).select("doc_id", F.md5(X.without_marks(F.col("text"))).alias("stripped"))


@query(f"SELECT item_id, CAST(pos AS INTEGER) AS pos, token FROM (SELECT item_id, unnest(l) AS token, unnest(range(len(l))) AS pos FROM (SELECT item_id, regexp_extract_all({_clean_sql('text')}, '{_TOKEN_SQL}') AS l FROM benchmark))")
def tok_punct_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.word_tokens(X.cleaned(F.col("text")))).alias("pos", "token"))


# A vocabulary of our own: letters but q and z, and frequent parts of words, as starts and continuations.
_PARTS = [*"abcdefghijklmnoprstuvwxyäöüßéèêçíóñ", "th", "the", "er", "on", "an", "re", "nd", "ed", "ha", "en", "ing", "tion", "nt", "st", "ou", "ea", "sch", "ch", "ment", "ción", ".", ",", "|", "!", "$", "%", "&", "#", "*"]
_VOCAB = [(200 + i, p) for i, p in enumerate([*_PARTS, "", *(f"##{p}" for p in _PARTS), " the ", "of"])]
_VOCAB_SQL = "vocab_lines(id, line) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in _VOCAB) + "), vocab AS (SELECT trim(line) AS token, max(id) AS id FROM vocab_lines WHERE trim(line) <> '' GROUP BY 1)"
_BASIC_SQL = f"regexp_extract_all({_marks_sql(_cjk_sql(_clean_sql('lower(text)')))}, '{_TOKEN_SQL}')"


def _vocab(spark: SparkSession) -> DataFrame:
    return W.vocabulary(literal(spark, "id, line", _VOCAB))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
v AS (SELECT row_number() OVER (ORDER BY doc_id, n) - 1 AS id, trim(line) AS token FROM l) SELECT md5(token) AS token, max(id) AS id FROM v WHERE token <> '' GROUP BY token""")
def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents as a vocabulary: every line takes an id, blank ones too, and the last of equal ones keeps its own."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = numbered(rows, "doc_id", "n").select(F.col("number").alias("id"), "line")
    return W.vocabulary(lines).select(F.md5("token").alias("token"), "id")


@query("""WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS chr FROM documents), n AS (SELECT row_number() OVER (ORDER BY chr) AS idx, chr FROM c WHERE chr NOT IN ('', chr(10)))
SELECT 0 AS idx, '' AS chr UNION ALL SELECT * FROM n UNION ALL SELECT count(*) + 1, ' ' FROM n""")
def ctc_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recognizer's dictionary of the documents' characters: blank at 0, lines as they are (not trimmed), a space at the end."""
    letters = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("chr")).where("chr not in ('', '\\n')").distinct()
    return framed(numbered(letters, "chr").select((F.col("number") + 1).alias("idx"), "chr"))


_PIECES_SQL = f"""{_VOCAB_SQL},
words AS (SELECT DISTINCT unnest({_BASIC_SQL}) AS word FROM benchmark),
walk(word, start, out, done) AS (
  SELECT word, 0, CAST([] AS VARCHAR[]), false FROM words WHERE octet_length(encode(word)) <= 200
  UNION ALL
  SELECT w.word, CASE WHEN n.e IS NULL THEN w.start ELSE n.e END, list_append(w.out, CASE WHEN n.e IS NULL THEN '[UNK]' ELSE (CASE WHEN w.start > 0 THEN '##' ELSE '' END) || w.word[w.start + 1 : n.e] END), n.e IS NULL
  FROM walk w CROSS JOIN LATERAL (SELECT max(r.e) AS e FROM range(w.start + 1, length(w.word) + 1) r(e) JOIN vocab v ON v.token = (CASE WHEN w.start > 0 THEN '##' ELSE '' END) || w.word[w.start + 1 : r.e]) n
  WHERE NOT w.done AND w.start < length(w.word)),
cut AS (SELECT word, out FROM walk WHERE done OR start = length(word) UNION ALL SELECT word, ['[UNK]'] FROM words WHERE octet_length(encode(word)) > 200)"""


@query(f"WITH RECURSIVE {_PIECES_SQL} SELECT word, array_to_string(out, ' ') AS pieces FROM cut")
def tok_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.basic_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.array_join(W.splitter(_vocab(spark))(F.array("word")), " ").alias("pieces"))


@query(f"""WITH RECURSIVE {_PIECES_SQL},
toks AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM (SELECT item_id, {_BASIC_SQL} AS l FROM benchmark)),
ps AS (SELECT t.item_id, t.pos, unnest(c.out) AS piece, unnest(range(len(c.out))) AS sub FROM toks t JOIN cut c ON c.word = t.word),
ids AS (SELECT item_id, list(coalesce(v.id, 100) ORDER BY pos, sub) AS ids FROM ps LEFT JOIN vocab v ON v.token = ps.piece GROUP BY item_id),
f AS (SELECT b.item_id, list_concat(list_concat([101], coalesce(ids[1:50], CAST([] AS INTEGER[]))), [102]) AS l FROM benchmark b LEFT JOIN ids ON ids.item_id = b.item_id)
SELECT item_id, array_to_string(list_concat(l, list_transform(range(52 - len(l)), lambda x: 0)), ' ') AS ids FROM f""")
def tok_encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to 52 ids: the vocabulary's ids join on the pieces, 100 where there is none."""
    vocab = _vocab(spark)
    pieces = W.splitter(vocab)(X.basic_tokens(F.col("text")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode_outer(F.slice(pieces, 1, W.CONTEXT)).alias("pos", "token"))
    ids = rows.join(vocab, "token", "left").withColumn("id", F.when(F.col("pos").isNotNull(), F.coalesce("id", F.lit(W.UNKNOWN)).cast("long")))
    listed = ids.groupBy("item_id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("l"))
    return listed.select("item_id", F.array_join(W.framed(F.transform("l", lambda r: r["id"])), " ").alias("ids"))


_SENTENCES_SQL = """list_filter(list_transform(string_split(regexp_replace({t}, '([。！？.!?\n])', '\\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"""
_CLAUSES_SQL = """list_filter(list_transform(string_split(regexp_replace({t}, '([，；,;])', '\\1' || chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"""


@query(f"""WITH s AS (SELECT doc_id, {_SENTENCES_SQL.format(t='text')} AS l, text FROM documents),
f AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [text] ELSE flatten(list_transform(l, lambda q: CASE WHEN length(q) > 120 THEN {_CLAUSES_SQL.format(t='q')} ELSE [q] END)) END AS l FROM s)
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS n, unnest(l) AS sentence FROM f""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("n", "sentence"))


_VLM = "'(' || doc_id % 50 || ',20),(3,' || doc_id % 70 || ') ' || text"
# The form of a line that names its box.
_BOX = r"\(([0-9]+),([0-9]+)\),\(([0-9]+),([0-9]+)\)\s*(.*)"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace({_VLM}, '^\\s+|\\s+$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, CASE WHEN NOT contains(t, chr(10)) AND length(t) > 100 THEN flatten(list_transform({_SENTENCES_SQL.format(t='t')}, lambda q: CASE WHEN length(q) > 120 THEN {_CLAUSES_SQL.format(t='q')} ELSE [q] END)) ELSE string_split(t, chr(10)) END AS l FROM t),
e AS (SELECT doc_id, unnest(range(len(l))) AS n, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line FROM l),
p AS (SELECT *, CAST(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS paragraph_id,
  regexp_matches(line, '{_BOX}') AS boxed, regexp_extract(line, '{_BOX}', 1) AS a, regexp_extract(line, '{_BOX}', 2) AS b, regexp_extract(line, '{_BOX}', 3) AS c, regexp_extract(line, '{_BOX}', 4) AS d, trim(regexp_extract(line, '{_BOX}', 5)) AS rest FROM e)
SELECT doc_id, CAST(n AS INTEGER) AS n, CASE WHEN boxed AND rest <> '' THEN rest ELSE line END AS text, CASE WHEN boxed THEN least(CAST(a AS DOUBLE), CAST(c AS DOUBLE)) END AS x, CASE WHEN boxed THEN least(CAST(b AS DOUBLE), CAST(d AS DOUBLE)) END AS y,
  CASE WHEN boxed THEN abs(CAST(c AS DOUBLE) - CAST(a AS DOUBLE)) END AS w, CASE WHEN boxed THEN abs(CAST(d AS DOUBLE) - CAST(b AS DOUBLE)) END AS h, 0.9::DOUBLE AS score, paragraph_id FROM p WHERE line <> ''""")
def vlm_parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a model's plain output: boxes where a line names them; the paragraph is the number of blank lines before."""
    raw = F.concat(F.lit("("), F.col("doc_id") % 50, F.lit(",20),(3,"), F.col("doc_id") % 70, F.lit(") "), "text")
    text = X.stripped(raw)
    lines = F.when(~F.contains(text, F.lit("\n")) & (F.length(text) > X.LONG_LINE), X.sentences(text)).otherwise(F.split(text, "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\u0085  ]"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("n", "line")).withColumn("line", X.stripped(F.col("line")))
    blank = F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("n"))
    rows = rows.withColumn("paragraph_id", blank).where("line != ''")
    part = lambda i: F.regexp_extract("line", _BOX, i)
    boxed = F.rlike("line", F.lit(_BOX))
    number = lambda i: F.when(boxed, part(i).try_cast("double"))
    rest = F.trim(part(5))
    return rows.select("doc_id", "n", F.when(boxed & (rest != ""), rest).otherwise(F.col("line")).alias("text"), F.least(number(1), number(3)).alias("x"), F.least(number(2), number(4)).alias("y"), F.abs(number(3) - number(1)).alias("w"), F.abs(number(4) - number(2)).alias("h"), F.lit(0.9).alias("score"), "paragraph_id")


@query(r"""WITH t AS (SELECT doc_id, unnest([text, replace(text, ' ', ''), '中文字符的文本很长很长' || doc_id]) AS text, unnest([0, 1, 2]) AS kind FROM documents),
c AS (SELECT *, length(text) AS n, length(text) - length(replace(text, ' ', '')) AS s, length(text) - length(regexp_replace(text, '[\x{4E00}-\x{10FFFF}]', '', 'g')) AS h FROM t)
SELECT doc_id, kind, CASE WHEN n < 10 OR CAST(s AS DOUBLE) / greatest(n, 1) > 0.05 THEN 'spell' WHEN h > n * 0.3 THEN 'keep' ELSE 'mend' END AS gate FROM c""")
def space_restore_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(F.col("text"), F.replace("text", F.lit(" "), F.lit("")), F.concat(F.lit("中文字符的文本很长很长"), F.col("doc_id")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(kinds).alias("kind", "text"))
    return rows.select("doc_id", "kind", X.space_gate(F.col("text")).alias("gate"))


def _spaced_sql(t: str) -> str:
    for pattern, to in X.LOST_SPACES:
        t = f"regexp_replace({t}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return t


@query(f"SELECT page_id, {_spaced_sql('url || replace(html, chr(32), chr(44))')} AS spaced FROM pages")
def space_restore_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("url", F.replace("html", F.lit(" "), F.lit(",")))
    return table(spark, sf_dir, "pages").select("page_id", X.spaced(text).alias("spaced"))


@query()
def word_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their spaces, long runs of letters split into the likeliest words by the documents' word frequencies."""
    words = R.frequencies(table(spark, sf_dir, "documents"))
    runs = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit(" "), F.lit("")).alias("run"))
    return runs.select("item_id", R.run_splitter(spark, R.ranked(words))("run").alias("words"))


_MISREAD = "substr(tok, 1, 2) || 'q' || substr(tok, 4)"


@query(f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), dict AS (SELECT word, count(*) / CAST((SELECT count(*) FROM w) AS DOUBLE) AS freq FROM w GROUP BY word),
t AS (SELECT DISTINCT {_MISREAD} AS tok FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS tok FROM benchmark)),
e AS (SELECT tok, lower(tok) AS low FROM t WHERE length(tok) BETWEEN 5 AND 20 AND tok <> upper(tok)),
u AS (SELECT DISTINCT low FROM e WHERE low NOT IN (SELECT word FROM dict WHERE freq > 5e-7)),
c AS (SELECT low, word, row_number() OVER (PARTITION BY low ORDER BY levenshtein(low, word), freq DESC, word) AS k FROM u JOIN dict ON abs(length(low) - length(word)) <= 2 AND levenshtein(low, word) <= 2 WHERE freq > 5e-7)
SELECT e.tok, CASE WHEN tok[1] <> lower(tok[1]) AND tok[2:] = lower(tok[2:]) THEN upper(word[1]) || lower(word[2:]) WHEN tok = upper(tok) THEN upper(word) ELSE word END AS fixed FROM e JOIN c ON c.low = e.low WHERE k = 1""")
def spell_correct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of misread words: the nearest of the documents' words within two edits, the more frequent first, in the word's case.

    Words meet on what is left of them without up to two letters, an ordinary join on a key.
    """
    words = R.frequencies(table(spark, sf_dir, "documents"))
    toks = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("tok")).select(F.expr(_MISREAD).alias("tok")).distinct()
    toks = toks.where("length(tok) between 5 and 20 and tok != upper(tok)").withColumn("low", F.lower("tok"))
    unknown = toks.select("low").distinct().join(words.select(F.col("word").alias("low")), "low", "left_anti")
    best = R.corrections(unknown, words)
    return toks.join(best, "low").select("tok", X.case_like(F.col("tok"), F.col("word")).alias("fixed"))


@query()
def text_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over benchmark texts as they are, without spaces, and with a misread letter."""
    kinds = F.array("text", F.replace("text", F.lit(" "), F.lit("")), F.regexp_replace("text", "ea", "eq"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(kinds).alias("kind", "text")).withColumn("id", F.struct("item_id", "kind"))
    done = R.restored(rows.select("id", "text"), R.frequencies(table(spark, sf_dir, "documents")))
    return done.select("id.item_id", "id.kind", F.col("text").alias("restored"))


@query(r"SELECT page_id, regexp_extract('INFO: Uvicorn running on ' || url || '/ (Press CTRL+C)', 'Uvicorn running on (http\S*)', 1) AS raw, rtrim(regexp_extract('INFO: Uvicorn running on ' || url || '/ (Press CTRL+C)', 'Uvicorn running on (http\S*)', 1), '/') AS url, split_part(url || '#entry.onnx', '#', 1) AS archive, split_part(url || '#entry.onnx', '#', 2) AS entry FROM pages")
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server's address out of its log line, and an archive's URL split from its member."""
    line = F.concat(F.lit("INFO: Uvicorn running on "), "url", F.lit("/ (Press CTRL+C)"))
    raw = F.regexp_extract(line, r"Uvicorn running on (http\S*)", 1)
    member = F.concat("url", F.lit("#entry.onnx"))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), F.regexp_replace(raw, "/+$", "").alias("url"), F.split_part(member, F.lit("#"), F.lit(1)).alias("archive"), F.split_part(member, F.lit("#"), F.lit(2)).alias("entry"))


@query("SELECT page_id, trim('  ' || url || ' ') AS trimmed, lower(url) AS low, starts_with(url, 'https') AS secure, contains(url, 'example') AS example, concat(page_id, ':', length(url)) AS label FROM pages")
def string_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.concat(F.lit("  "), "url", F.lit(" "))).alias("trimmed"), F.lower("url").alias("low"), F.startswith("url", F.lit("https")).alias("secure"), F.contains("url", F.lit("example")).alias("example"), F.format_string("%d:%d", "page_id", F.length("url")).alias("label"))


@query("SELECT doc_id, to_base64(encode(text)) AS coded, md5(decode(from_base64(to_base64(encode(text))))) AS back FROM documents")
def base64_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.base64(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(coded, "[\r\n]", "").alias("coded"), F.md5(F.unbase64(coded)).alias("back"))


@query("SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, greatest(0, least(100, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 2 - 20)) AS percent, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS built FROM events")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of JSON with defaults, a clamped percentage, and JSON built back."""
    j = F.from_json("props", "k BIGINT, missing STRING")
    k = F.coalesce(F.col("j.k"), F.lit(0))
    return table(spark, sf_dir, "events").withColumn("j", j).select("event_id", k.alias("k"), F.coalesce("j.missing", F.lit("none")).alias("missing"), F.greatest(F.lit(0), F.least(F.lit(100), k * 2 - 20)).alias("percent"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("built"))
