"""Images: formats, filters, broken files, resampling, crops and batched models, each against plain loops."""

from __future__ import annotations

import itertools
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glintframe.operators import faces, ocr, pixels, scorer
from glintframe.sources import images as I


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def plain_filter(lines, kinds, step):
    """Filtered lines, byte by byte."""
    out = []
    for y, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        row = []
        for i, v in enumerate(line):
            a = line[i - step] if i >= step else 0
            b = lines[y - 1][i] if y else 0
            c = lines[y - 1][i - step] if y and i >= step else 0
            row.append((v - [0, a, b, (a + b) // 2, paeth(a, b, c)][kind]) % 256)
        out.append(bytes([kind, *row]))
    return b"".join(out)


def plain_png(samples, depth, colour, kinds=(0, 1, 2, 3, 4), woven=False, palette=None, pieces=1):
    """PNG of height x width x samples whole numbers."""
    def lines_of(part):
        rows = []
        for row in part:
            bits = "".join(f"{v:0{depth}b}" for px in row for v in px)
            rows.append([int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8)])
        return rows

    step = max(1, len(samples[0][0]) * depth // 8)
    parts = [[row[x::dx] for row in samples[y::dy]] for x, y, dx, dy in (I.PASSES if woven else [(0, 0, 1, 1)])]
    data = b"".join(plain_filter(lines, list(itertools.islice(itertools.cycle(kinds), len(lines))), step) for part in parts if part and part[0] for lines in [lines_of(part)])
    packed = zlib.compress(data)
    cut = -(-len(packed) // pieces)
    head = struct.pack(">IIBBBBB", len(samples[0]), len(samples), depth, colour, 0, 0, int(woven))
    body = chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + (chunk(b"PLTE", bytes(itertools.chain(*palette))) if palette else b"")
    return I.SIGNATURE + body + b"".join(chunk(b"IDAT", packed[k : k + cut]) for k in range(0, len(packed), cut)) + chunk(b"IEND", b"")


CASES = [(c, d, woven) for c, depths in I.DEPTHS.items() for d in depths for woven in (False, True)]


@pytest.mark.parametrize("colour, depth, woven", CASES)
def test_every_kind_of_png(colour, depth, woven):
    rng = np.random.default_rng(colour * 100 + depth)
    for height, width in ((1, 1), (3, 5), (11, 9), (2, 17)):
        palette = rng.integers(0, 256, (min(1 << depth, 200), 3)).tolist() if colour == 3 else None
        top = len(palette) if palette else 1 << depth
        samples = rng.integers(0, top, (height, width, I.SAMPLES[colour])).tolist()
        got = I.from_png(plain_png(samples, depth, colour, woven=woven, palette=palette, pieces=3))
        for y, x in itertools.product(range(height), range(width)):
            v = samples[y][x]
            if palette:
                want = palette[v[0]]
            else:
                v = [math.floor(s / 257 + 0.5) if depth == 16 else s * 255 // ((1 << depth) - 1) for s in v]
                want = [v[0]] * 3 if colour in (0, 4) else v[:3]
            assert got[y, x].tolist() == want


def test_round_trip_with_all_filters():
    rng = np.random.default_rng(5)
    for height, width in ((1, 1), (7, 3), (40, 33)):
        picture = rng.integers(0, 256, (height, width, 3)).astype(np.uint8)
        for kinds in (None, [0] * height, *([k] * height for k in range(1, 5)), rng.integers(0, 5, height)):
            assert (I.pixels_of(I.to_png(picture, kinds)) == picture).all()
    smooth = np.add.outer(np.arange(64), np.arange(64))[..., None].repeat(3, 2).astype(np.uint8)
    assert len(I.to_png(smooth)) < len(I.to_png(smooth, [0] * 64))


def test_pixmaps():
    assert I.pixels_of(b"P6 2 1 255\n" + bytes(range(6))).tolist() == [[[0, 1, 2], [3, 4, 5]]]
    assert I.pixels_of(b"P5\n#a 9\n# b\n1 2\n#c\n3\n" + bytes([0, 3])).tolist() == [[[0] * 3], [[255] * 3]]
    assert I.pixels_of(b"P5 1 1 65535 " + bytes([128, 0])).tolist() == [[[128] * 3]]


def test_broken_images_give_error_rows(spark):
    good = plain_png(np.zeros((4, 4, 3), int).tolist(), 8, 2)
    huge = I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 10_001, 1, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")
    bomb = I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(10**7))) + chunk(b"IEND", b"")
    wrong = [good[:k] for k in (0, 4, 8, 20, 33, len(good) - 13, len(good) - 1)]
    wrong += [b"GIF89a", b"P6", b"P6 2 2 255 abc", b"P6 0 1 255 ", b"P6 1 1 0 a", b"P6" + b" " * 5000, huge, good.replace(b"IHDR", b"IHDX"), good[:45] + bytes([good[45] ^ 255]) + good[46:], plain_png([[[7]]], 8, 3, palette=[(1, 2, 3)]), None]
    wrong += [I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, d, c, 0, f, w)) + chunk(b"IDAT", zlib.compress(bytes(100))) + chunk(b"IEND", b"") for d, c, f, w in ((3, 2, 0, 0), (8, 5, 0, 0), (8, 2, 1, 0), (8, 2, 0, 2), (8, 3, 0, 0))]
    rows = [(k, b) for k, b in enumerate(wrong)] + [(100, good), (100, good), (None, bomb)]
    out = I.decoded(spark.createDataFrame(rows, "path long, content binary").repartition(3)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.path is not None and r.path < 100:
            assert r.error.startswith("Invalid image") and r.pixels is None and r.width is None, r
        else:
            assert r.error is None and len(r.pixels) == r.width * r.height * 3


def test_files_and_writer(spark, tmp_path):
    rng = np.random.default_rng(3)
    pictures = {f"a/{k}.png": rng.integers(0, 256, (k + 1, 5, 3)).astype(np.uint8) for k in range(4)}
    (tmp_path / "a").mkdir()
    for name, p in pictures.items():
        (tmp_path / name).write_bytes(I.to_png(p))
    (tmp_path / "a/note.txt").write_text("no image")
    out = I.images(spark, str(tmp_path), "*.png")
    assert {r.path.split("/", maxsplit=-1)[-1]: (r.height, bytes(r.pixels)) for r in out.collect()} == {n[2:]: (p.shape[0], p.tobytes()) for n, p in pictures.items()}
    again = I.decoded(I.encoded(out))
    assert out.join(again, ["path", "pixels", "width", "height"]).count() == 4
    odd = spark.createDataFrame([(1, 2, 2, b"abc"), (2, None, 1, b"abc"), (3, 1, 1, None), (4, 0, 0, b""), (5, 1, 1, b"abc")], "path long, width int, height int, pixels binary")
    assert {r.path for r in I.encoded(odd).where("content is not null").collect()} == {5}


def plain_resize(image, width, height):
    """Cubic resampling, output pixel by output pixel."""
    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def taps(have, want, i):
        ratio = have / want
        s = max(ratio, 1)
        c = (i + 0.5) * ratio
        lo = min(max(math.floor(c - 2 * s), 0), have - 1)
        hi = min(max(math.ceil(c + 2 * s), lo + 1), have)
        w = [kernel((k - (c - 0.5)) / s) for k in range(lo, hi)]
        return [(k, v / sum(w)) for k, v in zip(range(lo, hi), w, strict=True)]

    out = np.zeros((height, width, 3))
    for y, x in itertools.product(range(height), range(width)):
        for (ky, wy), (kx, wx) in itertools.product(taps(image.shape[0], height, y), taps(image.shape[1], width, x)):
            out[y, x] += wy * wx * image[ky, kx]
    return np.clip(np.floor(np.round(out, 9) + 0.5), 0, 255)


@pytest.mark.parametrize("have, want", [((7, 5), (3, 9)), ((20, 31), (6, 4)), ((1, 1), (5, 3)), ((2, 9), (9, 2)), ((40, 3), (3, 3)), ((6, 6), (6, 5))])
def test_resized_against_loops(have, want):
    image = np.random.default_rng(1).integers(0, 256, (*have, 3)).astype(np.uint8)
    assert (pixels.resized(image, want[1], want[0]) == plain_resize(image, want[1], want[0])).all()
    assert (pixels.resized(np.full_like(image, 77), want[1], want[0]) == 77).all()


def test_preparations(spark):
    rng = np.random.default_rng(2)
    pictures = {"wide": (50, 7), "tall": (3, 40), "dot": (1, 1), "big": (700, 90)}
    rows = [(k, w, h, rng.integers(0, 256, (h, w, 3)).astype(np.uint8).tobytes()) for k, (w, h) in pictures.items()] + [("none", None, None, None)]
    df = spark.createDataFrame(rows, "path string, width int, height int, pixels binary")
    for model, want in {
        "detector": {"wide": (64, 32), "tall": (32, 64), "dot": (32, 32), "big": (704, 96)},
        "orientation": {k: (192, 48) for k in pictures},
        "recognizer": {"wide": (342, 48), "tall": (3, 48), "big": (373, 48)},
        "encoder": {k: (224, 224) for k in pictures},
        "face detector": {k: (640, 640) for k in pictures},
        "face": {"wide": (112, 112), "tall": (112, 112), "big": (112, 112)},
    }.items():
        got = {r.path: r for r in pixels.prepared(df, model).collect()}
        assert set(got) == {*pictures, "none"}
        assert {k: (r.width, r.height) for k, r in got.items() if r.tensor is not None} == want
        prep = pixels.PREPS[model]
        for k in want:
            t = np.frombuffer(got[k].tensor, np.float32).reshape(3, got[k].height, got[k].width)
            image = np.frombuffer(next(r[3] for r in rows if r[0] == k), np.uint8).reshape(pictures[k][1], pictures[k][0], 3)
            w, h = prep.size(*pictures[k])
            values = plain_resize(image, w, h) if w * h < 4000 else pixels.resized(image, w, h)
            if model != "recognizer" or image.mean() > 140:
                assert np.allclose(t[:, :h, :w], ((values / prep.unit - prep.mean) / prep.deviation).transpose(2, 0, 1), atol=1e-5)
            assert not t[:, h:].any() and not t[:, :, w:].any()


def test_dark_lines_are_inverted():
    image = np.full((48, 48, 3), (10, 20, 30), np.uint8)
    grey = (10 * 2126 + 20 * 7152 + 30 * 722) // 10_000
    t = pixels.tensor_of(image, pixels.PREPS["recognizer"])
    assert np.allclose(t, ((255 - grey) / 255 - 0.5) / 0.5)
    assert np.allclose(pixels.tensor_of(255 - image, pixels.PREPS["recognizer"])[0], ((245 / 255) - 0.5) / 0.5)


def test_straightened_against_a_solved_system():
    """The closed form against eight equations, pixel by pixel; turned crops; what lies beyond the border."""
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    turned = 0
    for _ in range(25):
        x, y, w, h = rng.integers(-5, 35), rng.integers(-5, 25), rng.integers(2, 15), rng.integers(2, 15)
        corners = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], float) + rng.random((4, 2)) * 2
        out = pixels.straightened(image, corners)
        far = lambda i, j: math.dist(corners[i], corners[j])
        wide, high = math.floor(max(far(0, 1), far(3, 2)) + 0.5), math.floor(max(far(0, 3), far(1, 2)) + 0.5)
        if min(wide, high) < 2:
            assert out is None
            continue
        rows, right = [], []
        for (u, v), (a, b) in zip([(0, 0), (wide, 0), (wide, high), (0, high)], corners, strict=True):
            rows += [[u, v, 1, 0, 0, 0, -u * a, -v * a], [0, 0, 0, u, v, 1, -u * b, -v * b]]
            right += [a, b]
        m = np.linalg.solve(np.array(rows, float), np.array(right))
        want = np.zeros((high, wide, 3), np.uint8)
        for v, u in itertools.product(range(high), range(wide)):
            z = m[6] * u + m[7] * v + 1
            sx, sy = (min(max(c, 0), top) for c, top in (((m[0] * u + m[1] * v + m[2]) / z, 39), ((m[3] * u + m[4] * v + m[5]) / z, 29)))
            x0, y0 = int(sx), int(sy)
            x1, y1 = min(x0 + 1, 39), min(y0 + 1, 29)
            fx, fy = sx - x0, sy - y0
            value = image[y0, x0] * (1 - fx) * (1 - fy) + image[y0, x1] * fx * (1 - fy) + image[y1, x0] * (1 - fx) * fy + image[y1, x1] * fx * fy
            want[v, u] = np.floor(np.round(value, 6) + 0.5)
        if high / wide >= 1.5:
            want, turned = np.rot90(want, -1), turned + 1
        assert out.shape == want.shape and abs(out.astype(int) - want).max() <= 1
    assert turned


def test_crops_of_a_picture_with_very_many_boxes(spark):
    """A picture's boxes come in several lists; each crop is what slicing gives."""
    rng = np.random.default_rng(6)
    image = rng.integers(0, 256, (50, 60, 3)).astype(np.uint8)
    pictures = spark.createDataFrame([("p", 60, 50, image.tobytes()), ("q", None, None, None), (None, 1, 1, b"abc")], "path string, width int, height int, pixels binary")
    boxes = [("p", k, int(rng.integers(-30, 80)), int(rng.integers(-30, 70)), int(rng.integers(-3, 20)), int(rng.integers(-3, 20))) for k in range(700)]
    df = spark.createDataFrame([*boxes, ("q", 1, 1, 1, 5, 5), ("r", 1, 1, 1, 5, 5), (None, 1, 0, 0, 5, 5), ("p", 9999, None, 1, 5, 5)], "path string, part long, x int, y int, w int, h int")
    out = {r.part: r for r in pixels.box_crops(pictures, df, 10, most=64).collect()}
    assert set(out) == {*range(700), 9999} and out[9999].pixels is None
    some = 0
    for _, k, x, y, w, h in boxes:
        x0, y0 = max(x - 10, 0), max(y - 10, 0)
        cw, ch = min(w + 20, 60 - x0), min(h + 20, 50 - y0)
        if cw < 2 or ch < 2:
            assert out[k].pixels is None and out[k].width is None
        else:
            some += 1
            assert (out[k].width, out[k].height, bytes(out[k].pixels)) == (cw, ch, image[y0 : y0 + ch, x0 : x0 + cw].tobytes())
    assert 0 < some < 700


class Counting(scorer.Linear):
    calls: list = []

    def score_batch(self, x, widths):
        Counting.calls.append((x.shape, list(widths)))
        return super().score_batch(x, widths)


def test_packs_bound_the_calls():
    rng = np.random.default_rng(1)
    shapes = [(int(w), int(h)) for w, h in zip(rng.integers(1, 500, 333), rng.choice([32, 48], 333), strict=True)]
    got = scorer.packs(shapes, 16, 64)
    assert sorted(itertools.chain(*got)) == list(range(333)) and all(len(p) <= 16 and p == sorted(p) for p in got)
    kinds = {(h, scorer.width_of(w)) for w, h in shapes}
    assert len(got) <= math.ceil(333 / 16) + len(kinds)
    assert all(len({(shapes[i][1], scorer.width_of(shapes[i][0])) for i in p}) == 1 for p in got)


def test_batched_models_keep_keys_and_order(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(60):
        w, h = int(rng.integers(1, 200)), int(rng.choice([4, 6]))
        t = rng.normal(size=(3, h, w)).astype(np.float32)
        c, y, x = np.indices(t.shape)
        want[k] = [float((t * ((c * 31 + y * 17 + x * 7 + o * 13) % 29 - 14) / 29).sum()) for o in range(2)]
        rows.append((k, w, h, t.tobytes()))
    rows.append((100, None, None, None))
    df = spark.createDataFrame(rows, "path long, width int, height int, tensor binary").coalesce(1)
    for held in (scorer.HELD, 5000):
        monkeypatch.setattr(scorer, "HELD", held)
        out = scorer.batched(df, "linear", batch=8).collect()
        assert [r.path for r in out] == list(range(60))
        assert all([r.y0, r.y1] == pytest.approx(want[r.path], abs=1e-3) for r in out)
    with pytest.raises(KeyError):
        scorer.batched(df, "no such model")


def test_turned_boxes_of_pictures(spark):
    """Bars turned by known angles in pictures of several sizes are found where they are."""
    rows, truth = [], {}
    for k, (angle, w, h) in enumerate([(0.0, 160, 120), (0.4, 160, 120), (-0.3, 200, 90)]):
        y, x = np.mgrid[:h, :w]
        cx, cy = w // 2, h // 2
        a, b = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle), -(x - cx) * math.sin(angle) + (y - cy) * math.cos(angle)
        picture = np.where((abs(a) <= 25) & (abs(b) <= 7), 230, 10).astype(np.uint8)[..., None].repeat(3, 2)
        rows.append(({"id": k}, w, h, picture.tobytes()))
        truth[k] = (cx, cy, angle)
    rows.append(({"id": 9}, 40, 40, bytes(4800)))
    out = ocr.detected(spark.createDataFrame(rows, "path struct<id:long>, width int, height int, pixels binary"), "bright").collect()
    assert {r.path.id for r in out} == set(truth) and len(out) == 3
    for r in out:
        cx, cy, angle = truth[r.path.id]
        xs, ys = [r[f"x{i}"] for i in range(4)], [r[f"y{i}"] for i in range(4)]
        assert (np.mean(xs), np.mean(ys)) == pytest.approx((cx, cy), abs=1.5) and abs(r.angle - angle) < 0.08
        assert math.hypot(xs[1] - xs[0], ys[1] - ys[0]) > 50


def test_text_pictures(spark):
    docs = spark.createDataFrame([(1, "é" * 50), (2, ""), (3, None), (4, "x" * 96)], "doc_id long, text string").withColumn("width", F.lit("caller's"))
    got = {r.doc_id: (r.height, bytes(r.pixels)) for r in I.text_pictures(docs).collect()}
    assert got == {1: (2, ("é" * 50).encode().ljust(192, b"\0")), 2: (1, bytes(96)), 3: (1, bytes(96)), 4: (1, b"x" * 96)}


def test_reading_pictures_end_to_end(spark):
    """Bars of grey levels, turned by an angle or upside down, are found, straightened, turned upright and read."""
    grey = {"b": 135, "c": 180, "d": 235}
    rows = []
    for k, (text, angle, down) in enumerate([("dcd", 0.0, False), ("cdc", 0.25, False), ("bcd", 0.0, True), ("dc", -0.2, True)]):
        h, w = 140, 240
        y, x = np.mgrid[:h, :w]
        a = (x - 120) * math.cos(angle) + (y - 70) * math.sin(angle)
        b = -(x - 120) * math.sin(angle) + (y - 70) * math.cos(angle)
        if down:
            a, b = -a, -b
        letter = np.clip(((a + 60) / 120 * len(text)).astype(int), 0, len(text) - 1)
        value = np.array([grey[c] for c in text])[letter]
        value = np.where(b < -6, 250, np.where(b > 6, value * 0.6, value))  # light from above
        picture = np.where((abs(a) <= 60) & (abs(b) <= 12), value, 5).astype(np.uint8)
        rows.append((k, w, h, picture[..., None].repeat(3, 2).tobytes(), text, down))
    df = spark.createDataFrame([r[:4] for r in rows], "path long, width int, height int, pixels binary")
    charset = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "idx int, chr string")
    out = {r.path: r for r in ocr.read(df, "bright", "top light", "levels", charset).collect()}
    assert {k: r.text for k, r in out.items()} == {k: r[4] for k, r in enumerate(rows)}
    assert {k: abs(r.angle) > 90 for k, r in out.items()} == {k: r[5] for k, r in enumerate(rows)}
    assert all(0.5 < r.score < 1 and r.part == 1 for r in out.values())


def test_embedded_faces(spark):
    """Each face's vector is what the model gives for its crop alone; faces beyond the border have zeros."""
    rng = np.random.default_rng(12)
    image = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    pictures = spark.createDataFrame([("p", 60, 40, image.tobytes())], "path string, width int, height int, pixels binary")
    boxes = [("p", 1, 5, 5, 20, 20), ("p", 2, -4, 30, 9, 9), ("p", 3, 90, 5, 5, 5), ("p", 4, None, 5, 5, 5), ("q", 5, 1, 1, 9, 9)]
    out = {r.part: r.embedding for r in faces.embedded(pictures, spark.createDataFrame(boxes, "path string, part long, x int, y int, w int, h int"), "linear", length=2).collect()}
    assert set(out) == {1, 2, 3, 4} and out[3] == out[4] == [0.0, 0.0]
    for part, (x, y, w, h) in {1: (0, 0, 40, 40), 2: (0, 20, 29, 20)}.items():
        t = pixels.tensor_of(image[y : y + h, x : x + w], pixels.PREPS["face"])
        assert t.shape == (3, 112, 112)
        wide = np.zeros((1, 3, 112, 128), np.float32)
        wide[0, :, :, :112] = t
        assert out[part] == pytest.approx(list(scorer.Linear().score_batch(wide, [112])[0][0]), rel=1e-5)
