"""Operators that SQL can't express, against brute force, planted shapes and round trips."""

from __future__ import annotations

import math
import random
from itertools import permutations

import numpy as np
import pytest

from glintframe.operators import align, cache, grid, pixels, restore, scorer
from glintframe.operators.segment import Splitter, trie


def test_hull_against_half_planes():
    """A point is a corner of the hull exactly if it is no mean of others: no two or three others hold it between them."""
    rng = random.Random(1)
    for _ in range(30):
        points = np.array(sorted({(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(rng.randint(3, 12))}))
        got = {tuple(p) for p in grid.hull(points)}
        for p in map(tuple, points):
            rest = [tuple(q) for q in points if tuple(q) != p]
            angles = sorted(np.arctan2(y - p[1], x - p[0]) for x, y in rest)
            widest = max(np.diff([*angles, angles[0] + 2 * np.pi]), default=0)
            assert (p in got) == (widest > np.pi + 1e-9), (p, points)


def test_tight_rectangle_against_turning():
    rng = np.random.default_rng(2)
    for _ in range(20):
        points = rng.integers(0, 30, (8, 2)).astype(float)
        h = grid.hull(points)
        if len(h) < 3:
            continue
        cx, cy, w, hh, angle = grid.tight_rectangle(h)
        turned = lambda a: points @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        areas = [np.prod(np.ptp(turned(a), axis=0)) for a in np.linspace(0, np.pi / 2, 2000)]
        assert w * hh <= min(areas) + 1e-6 and w >= hh and w * hh == pytest.approx(np.prod(np.ptp(turned(angle), axis=0)))
        corners = grid.corners_of(cx, cy, w, hh, angle)
        assert grid.mean_inside(np.ones((1, 1)), corners - points[0]) in (0.0, 1.0)
        assert turned(angle).min() == pytest.approx((corners @ np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])).min())


def test_turned_boxes_find_a_planted_bar():
    y, x = np.indices((120, 160))
    along, across = (x - 80 + (y - 60)) / np.sqrt(2), ((y - 60) - (x - 80)) / np.sqrt(2)
    bar = (abs(along) <= 15) & (abs(across) <= 6)
    prob = np.where(bar, 0.9, 0.05)
    prob[2:4, 2:4] = 0.9  # after growth by two pixels most of its box is dark
    (found,) = grid.turned_boxes(prob, 2.0)
    _, cx, cy, w, h, angle, score = found
    assert (cx, cy) == pytest.approx((160, 120), abs=2) and abs(abs(angle) - np.pi / 4) < 0.1 and w > 1.4 * h
    assert not grid.turned_boxes(np.where(bar, 0.29, 0.0)) and not grid.turned_boxes(np.full((120, 160), 0.9))
    assert not grid.turned_boxes(np.where(bar, 0.31, 0.0))  # over the mask's threshold, under the score's


def test_reading_order_of_corners():
    want = np.array([[0, 0], [4, 1], [3, 5], [-1, 4]], float)
    for p in permutations(range(4)):
        assert (grid.in_reading_order(want[list(p)]) == want).all()


def test_sharpest_corners_are_the_square():
    square = np.array([[0, 0], [5, -0.1], [10, 0], [10, 10], [5, 10.1], [0, 10]])
    assert [(x, y) for _, x, y in grid.sharpest(square)] == [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_perspective_maps_corners():
    rng = np.random.default_rng(3)
    source = np.array([[0, 0], [10, 0], [10, 6], [0, 6]], float)
    for _ in range(20):
        target = source * 2 + rng.random((4, 2))
        a, b, c, d, e, f, g, h = grid.perspective(source, target)
        x, y = source.T
        z = g * x + h * y + 1
        assert np.allclose(np.stack([(a * x + b * y + c) / z, (d * x + e * y + f) / z], 1), target)


def test_text_boxes_find_a_planted_block(spark):
    rows = [(1, x, y, 0.9 if 5 <= x <= 20 and 8 <= y <= 13 else 0.1) for x in range(40) for y in range(30)]
    (r,) = grid.text_boxes(spark.createDataFrame(rows, "image_id long, x int, y int, prob double"), 40, 30).collect()
    # the block grown by two pixels, then by area * 1.6 / perimeter on each side
    grow = 20 * 10 * 1.6 / (2 * 30)
    assert (r.x, r.y) == pytest.approx((max(3 - grow, 0), max(6 - grow, 0)), abs=1) and r.w >= 20 and r.score > 0.5


def test_prepared_images_of_one_colour():
    prep = pixels.Prep(lambda w, h: (24, 20), lambda w, h: (24, 20), (0.1, 0.2, 0.3), (0.5, 0.25, 2.0))
    out = pixels.tensor_of(np.full((70, 32, 3), 102, np.uint8), prep)
    assert out.shape == (3, 20, 24) and np.allclose(out, np.array([0.6, 0.8, 0.05])[:, None, None])


def test_cache_is_built_once_and_again_for_another_mark(spark, tmp_path):
    built = []

    def build(n):
        def make():
            built.append(n)
            return spark.range(n).selectExpr("id")

        return make

    schema = spark.range(1).schema
    take = lambda mark, n: cache.kept(spark, str(tmp_path), mark, build(n), schema).count()
    assert [take("a", 3), take("a", 5), take("b", 7), take("a", 9)] == [3, 3, 7, 3] and built == [3, 7]
    spark.range(2).selectExpr("cast(id as string) as other").write.mode("overwrite").parquet(f"{tmp_path}/a")
    assert take("a", 4) == 4  # another schema: built again


def test_routed_scorers(spark):
    blobs = spark.createDataFrame([("a", bytearray(b"xyz"), "stub"), ("b", bytearray(b"xyz"), "stub-last"), ("c", bytearray(b""), None), ("d", bytearray(b"q"), "none such"), ("e", bytearray(b"q"), "stub-rows")], "path string, content binary, model string")
    got = {r.path: (r.model, r.size, r["first"]) for r in scorer.routed(blobs, "stub").collect()}
    assert got == {"a": ("stub", 3, 120), "b": ("stub-last", 3, 122), "c": ("stub", 0, -1), "d": ("stub", 1, 113), "e": ("stub", 1, 113)}


def test_null_blobs_crops_and_blocks(spark):
    blobs = spark.createDataFrame([("a", None, "stub"), ("b", bytearray(b"xy"), "stub-last"), ("c", None, "stub-last")], "path string, content binary, model string")
    assert [(r.path, r.size) for r in scorer.routed(blobs, "stub").collect()] == [("b", 2)]
    assert [r.path for r in scorer.run(blobs, "stub").collect()] == ["b"]
    crops = spark.createDataFrame([(1, 0, None), (1, 1, [2.0, 3.0]), (2, 0, None)], "image_id long, box_id int, pixels array<double>")
    assert {(r.image_id, r.box_id): (r.total, r.padded) for r in scorer.by_image(crops, "stub-rows").collect()} == {(1, 0): (0.0, 2), (1, 1): (5.0, 2), (2, 0): (0.0, 0)}
    assert align.merge(["ab", None, "cd"], "ab\ncd") == ["ab", "", "cd"] and align.merge([None], "") == [""]


def test_segment_against_all_splits():
    words = ["the", "water", "he", "at", "a", "wat", "er", "people"]
    cost, rng = {w: math.log((k + 1) * math.log(len(words))) for k, w in enumerate(words)}, random.Random(4)
    known = Splitter(trie(words))

    def every(run):
        return [[run]] + [[run[:k], *rest] for k in range(1, len(run)) for rest in every(run[k:])] if run else [[]]

    def total(split):
        return sum(cost[p] if p in cost else 20.0 * len(p) for p in split)

    for _ in range(40):
        run = "".join(rng.choices([*words, "z"], k=3))[:10]
        assert total(known.split(run)) == pytest.approx(min(map(total, every(run))))


def test_restored_texts(spark):
    texts = ["the people drink water"] * 5 + ["there is a number under the table", "The Number of people"]
    words = restore.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    shares = {r.word: r.freq for r in words.collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["the"] == max(shares.values())
    rows = {
        1: ("thepeopledrinkwater", "the people drink water"),  # mended
        2: ("the peoqle drink Watqr now and then", "the people drink Water now and then"),  # only spelled
        3: ("PEOQLE waaaatqqqr peo", "PEOQLE waaaatqqqr peo"),  # capitals, too far, too short
        4: ("人人人人人人人人人人peoqle", "人人人人人人人人人人peoqle"),  # mostly CJK
        5: (None, None),
        6: ("", ""),
        7: ("thepeople(numbers)3water", "the people ( number )3water"),
    }
    got = {r.id: r.text for r in restore.restored(spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "id long, text string"), words).collect()}
    for k in (1, 2, 3, 4, 5, 6):
        assert got[k] == rows[k][1], k
    assert got[7].replace(" ", "") in ("thepeople(numbers)3water", "thepeople(number)3water") and "the people (" in got[7]


def test_corrections_match_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(60)})
    freq = {w: 1 / (k + 2) for k, w in enumerate(words)}
    asked = sorted({"".join(rng.choices("abc", k=rng.randint(5, 8))) for _ in range(60)} - set(words))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for w in asked:
        near = sorted((edits(w, k), -freq[k], k) for k in words if edits(w, k) <= 2)
        if near:
            want[w] = near[0][2]
    got = restore.corrections(spark.createDataFrame([(w,) for w in asked], "low string"), spark.createDataFrame(list(freq.items()), "word string, freq double"))
    assert {r.low: r.word for r in got.collect()} == want
