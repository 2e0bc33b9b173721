"""Edge rows of single operators, worked out by hand."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from glintframe.functions import audio
from glintframe.functions import text as X
from glintframe.functions import vectors as V
from glintframe.operators import align, classify, ctc, grid, layout, segment, wordpiece
from glintframe.operators import boxes as B


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine_of_unequal_lengths_and_zero(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0))
    assert one(spark, V.cosine(a, b)) == 3 / 5
    assert one(spark, V.cosine(a, F.array(F.lit(0.0)))) == 0


def test_classify_ties_and_zero_vector(spark):
    tax = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 0, [2.0, 0.0]), (1, 5, [0.0, 1.0])], "cat_idx int, sub_idx long, v array<double>")
    vectors = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 0.0])], "vec_id long, v array<double>")
    best = {(r.vec_id, r.cat_idx): r.sub_idx for r in classify.best_prompts(vectors, tax).collect()}
    assert best[7, 0] == 0 and best[7, 1] == 5
    probs = {(r.vec_id, r.cat_idx): r.prob for r in classify.softmax(classify.best_prompts(vectors, tax)).collect()}
    assert probs[8, 0] == probs[8, 1] == 0.5
    by_blocks = {(r.vec_id, r.cat_idx): r.sub_idx for r in classify.best_prompts(vectors, tax, block=1).collect()}
    assert by_blocks == best


def test_classify_null_short_and_ragged_vectors(spark):
    """One rule at every size: dots over the shorter length, whole norms; nulls take no part."""
    tax = spark.createDataFrame([(0, 0, [3.0, 4.0]), (0, 1, [1.0, 0.0, 0.0]), (1, 2, [0.0, None]), (1, 3, None)], "cat_idx int, sub_idx long, v array<double>")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [3.0, 4.0, 12.0, 84.0]), (3, None), (4, [None, 1.0]), (5, [])], "vec_id long, v array<double>")
    for block in (1, 100):
        got = {(r.vec_id, r.cat_idx): (r.sub_idx, round(r.sim, 12)) for r in classify.best_prompts(vectors, tax, block).collect()}
        assert got == {(1, 0): (1, 1.0), (1, 1): (2, 0.0), (2, 0): (0, round(25 / 5 / 85, 12)), (2, 1): (2, 0.0), (4, 0): (0, 0.8), (4, 1): (2, 0.0), (5, 0): (0, 0.0), (5, 1): (2, 0.0)}


def test_nms_keeps_equal_overlap_and_chains(spark):
    # A and B overlap by exactly 0.4; C overlaps only a suppressed box
    rows = [(1, 0, 0, 0, 10, 7, 0.9), (1, 1, 0, 0, 10, 10, 0.8), (1, 2, 0, 6, 10, 10, 0.7)]
    boxes = spark.createDataFrame(rows, "image_id long, box_id int, x int, y int, w int, h int, confidence double")
    assert sorted(r.box_id for r in B.nms(boxes).collect()) == [0, 2]
    exact = spark.createDataFrame([(1, 0, 0, 0, 7, 10, 0.9), (1, 1, 3, 0, 7, 10, 0.8)], boxes.schema)
    assert sorted(r.box_id for r in B.nms(exact, 0.4).collect()) == [0, 1]


def test_anchor_width_comes_from_the_unclamped_corner(spark):
    l = F.lit  # noqa: E741
    box = one(spark, B.anchor_box(l(0), l(8), 2, 640, l(1.0), l(0.0), l(1.0), l(0.0), l(1.0)))
    assert (box.x, box.y, box.w, box.h) == (0, 0, 16, 1)


def test_paragraphs(spark):
    rows = [(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.0, 25.0, 10.0, 10.0), (1, 2, 5.0, 60.0, 10.0, 10.0), (1, 3, 0.0, 5.0, 0.0, 10.0), (1, 4, 5.0, 0.0, 10.0, 10.0)]
    lines = spark.createDataFrame(rows, "image_id long, line_id int, x double, y double, w double, h double")
    got = {r.line_id: r.paragraph_id for r in layout.paragraphs(lines).collect()}
    assert got[0] == got[1] == got[4] == 0  # gap of exactly 1.5 heights and overlap of exactly a half link
    assert got[3] == 1 and got[2] == 2  # no width: alone


def test_ctc_rules(spark):
    seq = [0, 1, 1, 0, 1, 9, 2]
    frames = spark.createDataFrame([(1, t, c, 0.0, 70.0, 7) for t, c in enumerate(seq)] + [(2, 0, 0, 0.0, 70.0, 7)], "crop_id long, t int, cls int, val double, box_w double, seq_len int")
    charset = spark.createDataFrame([(1, "a"), (2, "b")], "idx int, chr string")
    out = ctc.symbols(frames, charset)
    assert [(r.text, r.score) for r in ctc.text(out).collect()] == [("aab", 0.5)]
    assert [(r.t, r.x, r.w) for r in ctc.spans(out).orderBy("t").collect()] == [(1, 0.0, 20.0), (4, 40.0, 10.0), (6, 50.0, 20.0)]


def test_text_cleaning(spark):
    assert one(spark, X.cleaned(F.lit("a\x00b�\tc\x85d e"))) == "ab cd e"
    assert one(spark, X.cjk_spaced(F.lit("a中b"))) == "a 中 b"
    assert one(spark, X.without_marks(F.lit("éé"))) == "eé"
    assert one(spark, X.basic_tokens(F.lit("Don't 中x_"))) == ["don", "'", "t", "中", "x", "_"]


def test_sentences(spark):
    assert one(spark, X.sentences(F.lit("One. Two!Three"))) == ["One.", "Two!", "Three"]
    assert one(spark, X.sentences(F.lit("plain"))) == ["plain"]
    assert one(spark, X.sentences(F.lit("天。地？"))) == ["天。", "地？"]
    long = "a, " * 50
    assert one(spark, F.size(X.sentences(F.lit(long)))) == 50


def test_wordpiece():
    known = {"un", "##aff", "##able"}
    assert wordpiece.pieces("unaffable", known) == ["un", "##aff", "##able"]
    assert wordpiece.pieces("unx", known) == ["un", "[UNK]"]
    assert wordpiece.pieces("é" * 101, known) == ["[UNK]"]


def test_encode_frame(spark):
    ids = one(spark, wordpiece.framed(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda x: x.cast("long"))))
    assert len(ids) == 52 and ids[0] == 101 and ids[51] == 102 and ids[50] == 50


def test_merge_rules():
    assert align.merge([], "x") == []
    assert align.merge(["a", "b"], " ") == ["a", "b"]
    assert align.merge(["hello", "world"], "hello+\nworld") == ["hello+", "world"]
    assert align.merge(["hello", "world"], "hello\n* world") == ["hello", "* world"]
    assert align.merge(["helo", "world"], "hello\nworld") == ["hello", "world"]
    assert align.merge(["abc", "xyz"], "abc\nqq ww\nxyz") == ["abc", "xyz"]
    assert align.shares(5, [1, 1]) == [2, 3] and align.shares(7, [1, 1]) == [4, 3]


def test_gate_and_case(spark):
    assert one(spark, X.space_gate(F.lit("short"))) == "spell"
    assert one(spark, X.space_gate(F.lit("nospacesinthistext"))) == "mend"
    assert one(spark, X.space_gate(F.lit("中文中文中文中文中文"))) == "keep"
    assert one(spark, X.case_like(F.lit("Pvthon"), F.lit("python"))) == "Python"
    assert one(spark, X.spaced(F.lit("ab12(cD)e,f.G"))) == "ab 12 (c D) e, f. G"


def test_segment():
    known = segment.Splitter(segment.trie(["the", "water", "people"]))
    assert known.split("thewaterpeople") == ["the", "water", "people"]
    assert known.split("zzthe") == ["zz", "the"] and known.split("") == []
    assert segment.Splitter(segment.trie([])).split("ab") == ["ab"]


def test_wav_depths(spark):
    def wav(channels, bits, data, kind=1):
        head = struct.pack("<HHIIHH", kind, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
        return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data

    assert audio.read_wav(wav(1, 16, struct.pack("<hhb", 16384, -32768, 1))) == ([0.5, -1.0], 8000)
    assert audio.read_wav(wav(2, 16, struct.pack("<hhh", 16384, 0, 16384)))[0] == [0.25, 0.25]
    assert audio.read_wav(wav(1, 8, bytes([128, 192])))[0] == [0.0, 0.5]
    assert audio.read_wav(wav(1, 24, b"\x00\x00\x40"))[0] == [0.5]
    assert audio.read_wav(wav(1, 32, struct.pack("<f", 0.25), kind=3))[0] == [0.25]
    files = spark.createDataFrame([("a", bytearray(wav(1, 16, struct.pack("<h", 16384))))], "path string, content binary")
    assert audio.wav_samples(files).first()["samples"] == [0.5]
    assert one(spark, audio.mono(F.array(*(F.lit(float(v)) for v in (1, 3, 5))), 2)) == [2.0, 2.5]


def test_geometry():
    square = np.array([[0, 0], [2, 0], [2, 2], [0, 2], [1, 0], [1, 1]])
    assert len(grid.hull(square)) == 4
    cx, cy, w, h, _ = grid.tight_rectangle(np.array([[0, 0], [4, 0], [4, 2], [0, 2]], float))
    assert (cx, cy, w, h) == (2, 1, 4, 2)
    m = grid.perspective(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[2, 3], [4, 3], [4, 5], [2, 5]]))
    assert np.allclose(m, [2, 0, 2, 0, 2, 3, 0, 0])
    assert grid.perspective(np.zeros((4, 2)), np.zeros((4, 2))) is None


def test_malformed_wav_gives_an_error_row(spark):
    files = spark.createDataFrame([("a", bytearray(b"RIFF")), ("b", None), ("c", bytearray(b"x" * 12 + b"fmt \x04\x00\x00\x00abcd"))], "path string, content binary")
    got = audio.wav_samples(files).collect()
    assert len(got) == 3 and all(r.error and r.rate is None and r.samples is None for r in got)
