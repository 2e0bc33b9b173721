"""Images: reading PNG and portable pixmaps into RGB pixels, and writing PNG.

A blob that is no image, is cut or is larger than allowed gives a row with an error, not a
failed job. All rows of many PNGs are unfiltered at once along diagonals: a pixel needs its left,
upper and upper left neighbours, which lie on the two diagonals before.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import cycle, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest side that is decoded.
LONGEST = 10_000
#: Bytes of pixels or tensors of an Arrow batch that a task gives, about.
GIVEN = 16 << 20
#: Bytes of filtered lines that are unfiltered together, about.
TOGETHER = 2 << 20

# Fixed values of the PNG format: its signature; samples a pixel by colour type; bit depths that a colour type may have; first column, first row and steps of the seven interlaced passes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


class BadImage(ValueError):
    pass


def unfiltered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Bytes of filtered lines (height x bytes), each with its kind of filter (0 to 4); `step` bytes a pixel."""
    return unfiltered_all([(lines, kinds, step)])[0]


def unfiltered_all(blocks: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """unfiltered of many (lines, kinds, step), of which those of like widths go together."""
    out: list[np.ndarray] = [np.empty(0)] * len(blocks)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (lines, _, step) in enumerate(blocks):
        groups.setdefault((step, (lines.shape[1] // step).bit_length()), []).append(k)
    for (step, _), members in groups.items():
        members.sort(key=lambda k: -len(blocks[k][0]))
        for k, found in zip(members, _diagonals([blocks[k] for k in members], step), strict=True):
            out[k] = found
    return out


def _diagonals(blocks: list[tuple[np.ndarray, np.ndarray, int]], step: int) -> list[np.ndarray]:
    """Blocks from the highest to the lowest. All first rows stand together, then all second ones, and so on, so a diagonal is one range of rows."""
    heights, wide = np.array([len(b[0]) for b in blocks]), max(b[0].shape[1] // step for b in blocks)
    if not heights[0] or not wide:
        return [np.zeros((len(b[0]), 0), np.uint8) for b in blocks]
    having = np.searchsorted(-heights, -np.arange(heights[0]), side="left")  # blocks that have a row
    begin = np.concatenate([[0], np.cumsum(having)])
    places = [begin[:h] + k for k, h in enumerate(heights)]
    raw, kind = np.zeros((begin[-1], wide, step), np.uint8), np.zeros((begin[-1], 1), np.uint8)
    for at, (lines, kinds, _) in zip(places, blocks, strict=True):
        raw[at, : lines.shape[1] // step] = lines.reshape(len(lines), -1, step)
        kind[at, 0] = kinds
    row = np.repeat(np.arange(heights[0]), having)
    above = np.where(row > 0, np.arange(begin[-1]) - np.repeat(np.concatenate([[0], having[:-1]]), having), begin[-1])
    last, corners = np.zeros((begin[-1] + 1, step), np.int16), np.zeros((begin[-1], step), np.int16)  # the last one: above the first rows
    flat, base = raw.reshape(-1, step), np.arange(begin[-1]) * wide - row
    for at in range(heights[0] + wide - 1):
        low, high = begin[max(0, at - wide + 1)], begin[min(heights[0], at + 1)]
        left, corner, k = last[low:high], corners[low:high], kind[low:high]
        up = last[above[low:high]]
        far_left, far_up = up - corner, left - corner
        to_left, to_up, to_corner = abs(far_left), abs(far_up), abs(far_left + far_up)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.where(k == 4, nearest, np.where(k == 3, (left + up) >> 1, left * (k == 1) + up * (k == 2)))
        spots = base[low:high] + at
        found = (flat[spots] + guess) & 255
        corners[low:high] = up
        last[low:high] = found
        flat[spots] = found
    return [raw[at, : b[0].shape[1] // step].reshape(len(at), -1) for at, b in zip(places, blocks, strict=True)]


def filtered(lines: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """The inverse of unfiltered."""
    full = np.pad(lines.reshape(lines.shape[0], -1, step).astype(np.int16), ((1, 0), (1, 0), (0, 0)))
    left, up, corner, k = full[1:, :-1], full[:-1, 1:], full[:-1, :-1], kinds[:, None, None]
    near = left + up - corner
    to_left, to_up, to_corner = abs(near - left), abs(near - up), abs(near - corner)
    nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
    guess = np.where(k == 4, nearest, np.where(k == 3, (left + up) >> 1, left * (k == 1) + up * (k == 2)))
    return ((full[1:, 1:] - guess) & 255).astype(np.uint8).reshape(lines.shape)


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at < len(content):
        if at + 8 > len(content):
            raise BadImage("cut within a chunk")
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if len(content) < at + 12 + size:
            raise BadImage("cut within a chunk")
        if zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + size : at + 12 + size])[0]:
            raise BadImage("wrong checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadImage("no end")


def _samples(lines: np.ndarray, width: int, samples: int, depth: int) -> np.ndarray:
    """Height x width x samples from unfiltered lines; 16 bits are rounded to 8."""
    if depth == 8:
        return lines.reshape(len(lines), width, samples)
    if depth == 16:
        wide = lines.reshape(len(lines), width, samples, 2).astype(np.uint32)
        return ((wide[..., 0] * 256 + wide[..., 1] + 128) // 257).astype(np.uint8)
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, :width]
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[..., None]


def _checked(width: int, height: int) -> None:
    if not width or not height:
        raise BadImage("no pixels")
    if max(width, height) > LONGEST:
        raise BadImage(f"larger than {LONGEST} pixels a side")


#: Filtered blocks of a picture, and what makes its pixels of them once they are unfiltered.
Parsed = tuple[list[tuple[np.ndarray, np.ndarray, int]], Callable[[list[np.ndarray]], np.ndarray]]


def from_png(content: bytes) -> np.ndarray:
    """Height x width x 3 bytes; transparency is left out, grey and palettes become RGB."""
    blocks, finish = parsed_png(content)
    return finish(unfiltered_all(blocks))


def parsed_png(content: bytes) -> Parsed:
    head, palette, data = None, None, []
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            if len(body) != 13:
                raise BadImage("wrong header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise BadImage("no header")
    width, height, depth, colour, packed, filters, woven = head
    _checked(width, height)
    if depth not in DEPTHS.get(colour, ()) or packed or filters or woven > 1 or (colour == 3 and palette is None):
        raise BadImage("wrong header")
    samples = SAMPLES[colour]
    passes = [(x, y, dx, dy) for x, y, dx, dy in (PASSES if woven else [(0, 0, 1, 1)]) if x < width and y < height]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    bytes_of = lambda w: -(-w * samples * depth // 8)
    need = sum(h * (1 + bytes_of(w)) for w, h in sizes)
    try:
        flat = zlib.decompressobj().decompress(b"".join(data), need)
    except zlib.error as e:
        raise BadImage("broken data") from e
    if len(flat) < need:
        raise BadImage("cut data")
    at, step, blocks = 0, max(1, samples * depth // 8), []
    for w, h in sizes:
        block = np.frombuffer(flat, np.uint8, h * (1 + bytes_of(w)), at).reshape(h, -1)
        at += block.size
        if block[:, 0].max() > 4:
            raise BadImage("unknown filter")
        blocks.append((block[:, 1:], block[:, 0], step))

    def finish(found: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((height, width, samples), np.uint8)
        for lines, (x, y, dx, dy), (w, _) in zip(found, passes, sizes, strict=True):
            out[y::dy, x::dx] = _samples(lines, w, samples, depth)
        if colour == 3:
            if out.max() >= len(palette):
                raise BadImage("a colour outside the palette")
            return palette[out[..., 0]]
        if depth < 8:
            out = out * np.uint8(255 // ((1 << depth) - 1))
        return np.repeat(out[..., :1], 3, axis=2) if colour in (0, 4) else out[..., :3]

    return blocks, finish


def from_pixmap(content: bytes) -> np.ndarray:
    """Binary portable pixmaps and greymaps (P6, P5); values of any range become 0 to 255."""
    head = re.match(rb"P([56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", content)
    if head is None:
        raise BadImage("wrong header")
    kind, width, height, top = (int(v) for v in head.groups())
    _checked(width, height)
    if not 0 < top < 65_536:
        raise BadImage("wrong range")
    samples, each = (3 if kind == 6 else 1), (1 if top < 256 else 2)
    if len(content) - head.end() < width * height * samples * each:
        raise BadImage("cut data")
    v = np.frombuffer(content, ">u2" if each == 2 else np.uint8, width * height * samples, head.end()).reshape(height, width, samples)
    if top != 255:
        v = (np.minimum(v.astype(np.uint32), top) * 255 + top // 2) // top
    return np.repeat(v.astype(np.uint8), 3 // samples, axis=2)


#: How a blob begins, and what reads it.
READERS: dict[bytes, Callable[[bytes], np.ndarray]] = {SIGNATURE: from_png, b"P5": from_pixmap, b"P6": from_pixmap}


def pixels_of(content: bytes) -> np.ndarray:
    for start, read in READERS.items():
        if content.startswith(start):
            return read(content)
    raise BadImage("unknown format")


def to_png(pixels: np.ndarray, kinds: Iterable[int] | None = None) -> bytes:
    """RGB pixels as PNG. kinds: the filter of each row; without it, the one whose differences are smallest."""
    height, width, _ = pixels.shape
    lines = np.ascontiguousarray(pixels).reshape(height, width * 3)
    if kinds is None:
        every = np.stack([filtered(lines, np.full(height, k), 3) for k in range(5)])
        cost = np.minimum(every, 256 - every.astype(np.int16)).sum(2)
        kinds = cost.argmin(0)
    kinds = np.fromiter(kinds, np.int64, height)
    data = np.concatenate([kinds[:, None].astype(np.uint8), filtered(lines, kinds, 3)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(data.tobytes())) + chunk(b"IEND", b"")


def as_text(key: Column, kind: T.DataType) -> Column:
    """A key as text, so that it takes any type through Python; a struct as JSON."""
    return F.to_json(key) if isinstance(kind, T.StructType) else key.cast("string")


def from_text(key: Column, kind: T.DataType) -> Column:
    return F.from_json(key, kind) if isinstance(kind, T.StructType) else key.cast(kind)


def given(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about GIVEN bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= GIVEN or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def image_of(pixels: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, 3)


def _read(held: list[tuple[str, Parsed | BadImage]]) -> Iterator[tuple]:
    """(key, width, height, pixels, error) of parsed pictures, unfiltered together."""
    lines = iter(unfiltered_all([b for _, p in held if not isinstance(p, BadImage) for b in p[0]]))
    for name, p in held:
        try:
            if isinstance(p, BadImage):
                raise p
            pixels = p[1](list(islice(lines, len(p[0]))))
            yield name, pixels.shape[1], pixels.shape[0], pixels.tobytes(), None
        except BadImage as e:
            yield name, None, None, None, f"Invalid image: {e}"


def decoded(blobs: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, width, height, pixels (RGB, row by row) and error of each blob.

    A null, cut, broken, unknown or too large blob has an error that begins with `Invalid image`
    and nulls in the other columns. Each row of blobs gives one row, so repeated keys do, too. One
    image and a batch of about 16 MB are in a task's memory. Other columns of blobs are left out.
    """
    kind = blobs.schema[key].dataType
    schema = pa.schema([("key", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: list[tuple[str, Parsed | BadImage]] = []
            total = 0
            for batch in batches:
                for name, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    try:
                        if not blob.is_valid:
                            raise BadImage("no content")
                        content = blob.as_py()
                        one = parsed_png(content) if content.startswith(SIGNATURE) else ([], lambda _, p=pixels_of(content): p)
                        held.append((name, one))
                        total += sum(b[0].size for b in one[0]) or 3 * len(content)
                    except BadImage as e:
                        held.append((name, e))
                    if total >= TOGETHER or len(held) >= 4096:
                        yield from _read(held)
                        held, total = [], 0
            yield from _read(held)

        yield from given(rows(), schema, lambda r: len(r[3] or b""))

    rows = blobs.select(as_text(F.col(key), kind).alias("key"), F.col(content).cast("binary").alias("content"))
    out = rows.mapInArrow(read, "key string, width int, height int, pixels binary, error string")
    return out.select(from_text(F.col("key"), kind).alias(key), "width", "height", "pixels", "error")


def images(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, width, height, pixels and error of the image files under a path that Spark can read."""
    return decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def encoded(pictures: DataFrame, key: str = "path", kinds: tuple[int, ...] | None = None) -> DataFrame:
    """key and content, a PNG, of pictures (key, width, height, pixels); null where the pixels are null or not width x height x 3 bytes.

    kinds: the rows' filters in turn; without it, each row's best.
    """
    kind = pictures.schema[key].dataType
    schema = pa.schema([("key", pa.string()), ("content", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, w, h, p in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                    raw = p.as_py()
                    fits = raw is not None and w and h and w > 0 and h > 0 and len(raw) == w * h * 3
                    yield name, to_png(image_of(raw, w, h), kinds and islice(cycle(kinds), h)) if fits else None

        yield from given(rows(), schema, lambda r: len(r[1] or b""))

    rows = pictures.select(as_text(F.col(key), kind).alias("key"), "width", "height", "pixels")
    return rows.mapInArrow(write, "key string, content binary").select(from_text(F.col("key"), kind).alias(key), "content")


def text_pictures(docs: DataFrame, width: int = 32) -> DataFrame:
    """doc_id, width, height and pixels of pictures whose bytes are a document's, in rows of `width` pixels; the last row is filled with zeros, a null text is one black row."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    rows = F.greatest(F.ceil(F.octet_length(raw) / (3 * width)), F.lit(1)).cast("int")
    return docs.select("doc_id", F.lit(width).alias("width"), rows.alias("height"), F.rpad(raw, rows * (3 * width), F.lit(b"\0")).alias("pixels"))
