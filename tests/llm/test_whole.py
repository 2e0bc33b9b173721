"""Long texts, hot groups, odd rows and clashing columns, operator by operator and through the pipeline."""

from __future__ import annotations

import random
import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.llm import common, langid, mixing, ngram_join, quality, sharding, spm, substring, url_rules
from glintframe.llm.queries import SPM_MODEL
from tests.llm.test_operators import DOCS, brute_components, brute_removal, corpus

NAMES = ["at", "lost", "docs", "h", "row", "keep", "nth", "copy", "key", "n", "tokens", "learned", "fit", "score_", "__key", "__tokens", "__copies"]


def clashing(df):
    return df.withColumns({c: F.lit(f"caller's {c}") for c in NAMES if c not in df.columns})


def test_callers_columns_come_through(spark):
    docs = clashing(spark.createDataFrame(corpus(40), DOCS))
    model = quality.fit(docs.select("doc_id", "text", (F.col("doc_id") % 2).alias("quality")))
    names, prototypes = langid.fit(docs)
    for out in (substring.removal(docs), ngram_join.one_of_each(docs), mixing.mix(docs), quality.score(docs, model), langid.predict(docs, names, prototypes), spm.encoded(docs, SPM_MODEL)):
        rows = out.collect()
        assert rows and set(docs.columns) <= set(out.columns)
        assert all(r[c] == f"caller's {c}" for r in rows for c in NAMES)
    pages = clashing(spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string"))
    out = url_rules.filtered(pages, [], spark.createDataFrame([], "url string, label string"))
    assert all(r[c] == f"caller's {c}" for r in out.collect() for c in NAMES)


def test_one_long_url_in_a_small_table(spark):
    """41 labelled URLs, one of them with 60 parts: every rule that two URLs or more support, in seconds."""
    long = "http://long.org/" + "/".join(f"part{k:c}x" for k in range(97, 157))
    urls = [(long, "block")] + [(f"http://site.org/{'good' if k % 2 else 'bad'}/p", "allow" if k % 2 else "block") for k in range(40)]
    labelled = spark.createDataFrame(urls, "url string, label string")
    began = time.monotonic()
    rules = url_rules.mine(labelled.select(url_rules.tokens_of(F.col("url")).alias("tokens"), "label"))
    assert time.monotonic() - began < 60
    assert url_rules.judge(["p:bad"], rules) == "block" and url_rules.judge(["p:good"], rules) == "allow" and not any("part" in t for t in rules.groups)
    twice = spark.createDataFrame([*urls, (long, "block")], "url string, label string")
    found = url_rules.filtered(spark.createDataFrame([(1, long + "/more"), (2, "http://x.net/bad")], "page_id long, url string"), [], twice.where(F.length("url") < 200))
    assert {r.page_id: r.verdict for r in found.collect()} == {1: "allow", 2: "block"}


def test_a_long_text_of_many_letters_is_bundled_in_little_memory():
    rng = random.Random(1)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(330_000))
    letters = langid.Letters(langid.DIMENSIONS)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    v = langid.bundle(text, letters)
    assert v.shape == (langid.DIMENSIONS,) and len(letters.points) <= langid.READY
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # KB


def test_language_scores_against_brute_force(spark):
    """fit and predict against sums and cosines made letter by letter."""
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choices("abcd" if k % 2 else "cdef", k=3)) for _ in range(6)), "xy"[k % 2]) for k in range(12)]
    table = langid.Letters(langid.DIMENSIONS)

    def vector(text):
        line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        letter = lambda c, turn: np.roll(table.letter(0 if c == " " else ord(c)).astype(int), turn)
        return sum(letter(line[i], 2) * letter(line[i + 1], 1) * letter(line[i + 2], 0) for i in range(len(line) - 2))

    names, prototypes = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = np.stack([sum(vector(t) for _, t, lang in rows if lang == name) for name in names])
    assert names == ["x", "y"] and (prototypes == want).all()
    tests = [(k, t) for k, t in enumerate(["abc cde", "FAD!", "c", "aab\nfe", "abc cde"])]
    for r in langid.predict(spark.createDataFrame(tests, "doc_id long, text string"), names, prototypes).collect():
        v = vector(r.text)
        cos = want @ v / np.linalg.norm(want, axis=1) / np.linalg.norm(v)
        assert r.lang_pred == names[int(np.argmax(cos))] and r.score == pytest.approx(max(float(cos.max()), 0))


def test_semantic_space_is_that_of_the_exact_decomposition():
    """The leading axes give the same cosines as a full singular value decomposition of the weighted terms."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["apple pie", "red car!", "x = y + 1;", "ÜBER uns"], weights=[9 if k % 4 == j else 1 for j in range(4)], k=30)) for k in range(60)]
    found = [quality.counts(t) for t in texts]
    model = quality.fit_rows([(np.flatnonzero(x), x[np.flatnonzero(x)]) for x in found], [k % 2 for k in range(60)], axes=3)
    x = np.log1p(np.stack(found)) * np.log((1 + 60) / (1 + np.count_nonzero(np.stack(found), axis=0)))[None] + 0
    x = np.log1p(np.stack(found)) * (np.log(61 / (1 + np.count_nonzero(np.stack(found), axis=0))) + 0.1)
    for part in (x[:, : quality.STYLES], x[:, quality.STYLES :]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    _, _, right = np.linalg.svd(x, full_matrices=False)
    y = x @ right[:3].T
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert np.allclose(model.vectors @ model.vectors.T, y @ y.T, atol=5e-3)
    again = quality.latent(np.stack(found), model.weights, model.axes)
    assert np.allclose(again, model.vectors, atol=1e-4)


def test_equal_neighbours_vote_in_order_and_repeated_ids_once(spark):
    v = np.array([[1.0, 0.0]] * 6 + [[0.0, 1.0]], np.float32)
    model = quality.Model(np.ones(1), np.ones((1, 1)), v, np.array([1, 1, 0, 0, 0, 0, 0], np.float32), 0.5)
    assert quality.votes(np.array([[1.0, 0.0]], np.float32), model, 2)[0] == pytest.approx((2 + 0.05) / 2.1)
    rows = [(1, "good words", 1)] * 50 + [(2, "BAD!!", 0), (None, "x", 1)]
    assert len(quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int")).labels) == 2
    labels = spark.createDataFrame([(1, 1)] * 40 + [(1, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.quality) for r in quality.labelled_rows(docs, labels).collect()) == [(1, 0), (2, 1)]


def test_long_texts(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choices(words, k=300_000))
    near = long.replace(" w7 ", " W7X ", 100)
    rows = [(1, long, None, None, 0), (2, near, None, None, 0), (3, "short text", None, None, 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.component_id for r in ngram_join.joined(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    cut = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal(docs).collect()}
    assert cut == brute_removal(rows)
    assert all(r.exact for r in spm.digests(docs, SPM_MODEL).collect())


def test_a_hot_group_of_copies(spark):
    """A third of all rows are one text: counted once for each flush, linked as a star."""
    text = " ".join(f"v{k}" for k in range(40))
    rows = [(k, text if k % 3 == 0 else f"{text} other{k} words{k} here{k}" if k % 3 == 1 else f"own{k} text{k}", None, "s", 0) for k in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removal(docs).collect()} == brute_removal(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect()} == brute_components(rows, 80, 5)


def test_nulls_and_repeated_rows_in_mixing_and_sharding(spark):
    rows = [(None, f"text {k}", None, "s", 0) for k in range(60)] + [(7, "same text", None, "s", 0)] * 40 + [(8, None, None, None, 0)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.mixed(docs)
    assert plan.where("doc_id is null").select("h").distinct().count() == 60  # not all in one cell
    want, got = plan.agg(F.sum("copies")).first()[0], mixing.mix(docs)
    assert got.count() == want and got.where("doc_id = 7").count() == plan.where("doc_id = 7").agg(F.sum("copies")).first()[0]
    placed = sharding.shards(docs, 5).collect()
    assert sorted(r.position for r in placed) == list(range(len(rows)))


def pipeline_rows():
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    good = "The river ran past the old mill and the children walked along it to school every morning in spring."
    return [(1, good, "en", "a", len(good)), (1, good, "en", "a", len(good)), (2, good, "en", "a", len(good)), (None, good, "en", "a", 1), (None, None, None, None, None), (3, None, "en", None, None), (4, "", "en", "a", 0), (5, long, "en", "b", len(long)), (6, " \n", None, "b", 2)]


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipe

    new = ["score", "predicted", "n_words", "n_removed", "kept", "KEPT_SHA256", "own_score"]  # names that its operators give, too
    docs = clashing(spark.createDataFrame(pipeline_rows(), DOCS)).withColumns({c: F.lit(f"caller's {c}") for c in new})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(pipe.STAGES):
        out = common.written(stage(spark, now, str(tmp_path)))
        assert k == len(pipe.STAGES) - 1 or out.columns == docs.columns
        assert all(r[c] == f"caller's {c}" for r in out.collect() for c in [*NAMES, *new])
        now = out
    ids = [r.doc_id for r in now.collect()]
    assert 1 in ids and 2 not in ids  # the copy goes, its first stays
    assert {r.doc_id for r in now.where("text is null").collect()} <= {None, 3}
    assert all((r.ids is None) == (r.text is None) == (r.n_ids is None) for r in now.collect())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as pipe

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipe.run(spark, str(tmp_path)).count() == 0
