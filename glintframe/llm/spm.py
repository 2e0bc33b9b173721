"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The pieces and their scores come from a SentencePiece model file, given as a path
(the file itself is no part of this package). Encoding maximizes the sum of piece
scores. The automaton reads a text once; at each position its output links name all
pieces that end there, and each relaxes the best score of that position. A character
that no piece covers costs UNKNOWN below the least score and becomes its UTF-8 bytes'
pieces (byte fallback), so that decoding gives back any text exactly. On ties the
longest last piece wins.

Models of kind BPE score a piece by the negative of its merge rank; encoding here is
the best sum of these scores, not the order of merges.

Pieces hold the space sign only at their start, so the best path of a text is that of
its parts, each a run of spaces and the run of other characters after it. Parts that
recur are looked up in a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common

SPACE = "▁"
UNKNOWN = 10.0
#: Parts that a worker process keeps ready.
CACHE = 100_000
_NEVER = float("-inf")
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Codec:
    """Encoder and decoder over (piece, score) in id order; kinds names bytes and specials."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: dict[int, int], specials: set[int]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        self.automaton = ahocorasick.Automaton()
        plain = [(i, p, s) for i, (p, s) in enumerate(pieces) if i not in specials and i not in set(byte_ids.values()) and p]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in plain):
            raise ValueError("a piece holds the space sign after its start")
        for i, p, s in plain:
            self.automaton.add_word(p, (len(p), s, i))
        self.automaton.make_automaton()
        self.unknown = min((s for _, _, s in plain if s > -1e8), default=0.0) - UNKNOWN
        self.single = {p for _, p, _ in plain if len(p) == 1}
        self.lengths = [len(p) for p, _ in pieces]
        self.cache: dict[str, bytes] = {}
        self.bytes_of = {i: bytes([b]) for b, i in byte_ids.items()} | {i: p.replace(SPACE, " ").encode() for i, p, _ in plain}

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in n]
        byte_ids = {int(pieces[i][0][1:-1], 16): i for i in n if model.is_byte(i)}
        return cls(pieces, byte_ids, {i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)})

    def part(self, text: str) -> bytes:
        """Packed ids of the best segmentation of a text in which spaces are space signs."""
        n = len(text)
        best = [0.0] + [_NEVER] * n
        back = [-1] * (n + 1)
        if self.single.issuperset(text):
            for end, (length, score, piece) in self.automaton.iter(text):
                if (total := best[end + 1 - length] + score) > best[end + 1]:
                    best[end + 1], back[end + 1] = total, piece
        else:
            found: dict[int, list[tuple[int, float, int]]] = {}
            for end, match in self.automaton.iter(text):
                found.setdefault(end + 1, []).append(match)
            for end in range(1, n + 1):
                for length, score, piece in found.get(end, ()):
                    if (total := best[end - length] + score) > best[end]:
                        best[end], back[end] = total, piece
                if text[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
                    best[end], back[end] = best[end - 1] + self.unknown, -1
        out: list[int] = []
        lengths = self.lengths
        while n:
            piece = back[n]
            if piece < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
                n -= 1
            else:
                out.append(piece)
                n -= lengths[piece]
        out.reverse()
        return array("i", out).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in a row. A space sign of the text itself goes as bytes, so that it is not read back as a space."""
        if not text:
            return b""
        out: list[bytes] = []
        cache = self.cache
        for k, stretch in enumerate(text.split(SPACE)) if SPACE in text else ((0, text),):
            if k:
                out.append(array("i", [self.byte_ids[b] for b in SPACE.encode()]).tobytes())
            line = ("" if k else SPACE) + stretch.replace(" ", SPACE)
            for part in _PART.findall(line):
                ids = cache.get(part)
                if ids is None:
                    ids = self.part(part)
                    if len(part) <= 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[part] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def decode(self, ids) -> str:
        """The text of ids; without the space that stands for the start, and without special pieces."""
        of = self.bytes_of
        raw = b"".join([of.get(i, b"") for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process."""
    if path not in _codecs:
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def _shipped(df: DataFrame, path: str):
    """The model goes to executors with Spark's files; a worker opens its own copy."""
    df.sparkSession.sparkContext.addFile(path)
    name = path.rpartition("/")[2]
    return lambda: codec(SparkFiles.get(name))


def encoded(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """docs with `ids` (array<int>) of the whole text; null text: null, empty text: no ids.

    Other columns pass through; one of docs named `ids` is replaced.
    """
    opened = _shipped(docs, model)
    rest = docs.drop("ids")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = opened()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = common.text_column(part, column).to_pylist()
                packed = [b"" if t is None else c.encode_packed(t) for t in texts]
                ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
                offsets = pa.array(ends, mask=np.array([t is None for t in texts] + [False]))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return rest.mapInArrow(common.tidy(apply), common.schema_with(rest, ids=T.ArrayType(T.IntegerType())))


def decoded(rows: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """rows with `decoded`, the text of their ids; null ids: null. Ids that no piece has are skipped."""
    opened = _shipped(rows, model)
    rest = rows.drop("decoded")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = opened()
        for batch in batches:
            texts = [None if i is None else c.decode(i) for i in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return rest.mapInArrow(common.tidy(apply), common.schema_with(rest, decoded=T.StringType()))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes, n_ids, SHA-256 of the ids (little-endian 32-bit) and of the decoded text, and whether it is the text.

    Encoding and decoding run in one pass, so ids never leave the worker.
    """
    opened = _shipped(docs, model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = opened()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), common.text_column(batch, "text").to_pylist(), strict=True):
                if text is None:
                    rows.append((doc_id, None, None, None, None, None))
                    continue
                packed = c.encode_packed(text)
                back = c.decode(array("i", packed))
                rows.append((doc_id, len(text.encode()), len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            names = ["doc_id", "n_bytes", "n_ids", "ids_sha256", "decoded_sha256", "exact"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(common.tidy(apply), "doc_id long, n_bytes long, n_ids long, ids_sha256 string, decoded_sha256 string, exact boolean")
