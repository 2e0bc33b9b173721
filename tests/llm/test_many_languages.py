"""More languages than the former cap of 256."""

from __future__ import annotations

from glintframe.llm import langid


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 10)
    word = lambda k: "".join(chr(0x4E00 + 4 * k + m % 4) for m in range(24))
    rows = [(2 * k + m, f"{word(k)} {word(k)[m:]}", f"l{k:03}") for k in range(300) for m in range(2 if k < 290 else 1)]
    names, prototypes = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert names == [f"l{k:03}" for k in range(300)] and prototypes.shape == (300, langid.DIMENSIONS)
    docs = spark.createDataFrame([(k, word(k)) for k in range(300)], "doc_id long, text string")
    assert all(r.lang_pred == f"l{r.doc_id:03}" for r in langid.predict(docs, names, prototypes).collect())
