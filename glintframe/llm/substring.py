"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted over all documents.

1. Every document's windows are hashed. A map task combines FLUSH windows at a time: of
   each hash the smallest document stays to be counted, and larger ones are known to
   lose it there and then. So a window that very many documents share reaches the
   counting task once for each flush, not once for each document.
2. What stays goes to buckets by ranges of the hash, packed as arrays, so that a
   shuffled row holds hundreds of them. Spark sorts a partition's buckets; one bucket at
   a time gives for each hash its smallest document, and all others lose it.
3. Documents and what they lose meet in groups of bounded size, by doc_id. Each document
   finds its windows with those hashes and merges them into maximal removal intervals.

Hashes have 64 bits; of w windows about w**2 / 2**65 pairs collide by chance.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common, tokens

#: Windows that a task combines, or loses that it hands on, at once.
FLUSH = 1 << 20
#: Bytes of text for each partition and group of documents; buckets of a partition.
PIECE_BYTES, BUCKETS = 8 << 20, 4


def windows(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of a chunk, and each document's first (one entry more at the end)."""
    hashes, of = tokens.words(data, bounds, lower=False)
    rolled = tokens.rolling(hashes, width)
    count = np.maximum(np.diff(of) - width + 1, 0)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    index = np.arange(first[-1]) + np.repeat(of[:-1] - first[:-1], count)
    return rolled[index], first


#: A row holds documents, how many hashes follow for each, and those hashes: of a bucket, or lost by a group of documents.
_PACK = pa.schema([("at", pa.int32()), ("lost", pa.bool_()), ("docs", pa.binary()), ("runs", pa.binary()), ("hashes", pa.binary())])
_PACK_DDL = "at int, lost boolean, docs binary, runs binary, hashes binary"


def _starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([np.ones(1, bool), x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def _group(docs: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents in which a doc_id is settled: CRC-32 of its digits modulo groups, as in SQL."""
    ids, inverse = np.unique(docs, return_inverse=True)
    return np.array([zlib.crc32(b"%d" % d) % groups for d in ids.tolist()], np.int32)[inverse]


def _pack(docs: np.ndarray, hashes: np.ndarray, at: np.ndarray, lost: bool) -> pa.RecordBatch:
    """One row for each value of at."""
    order = np.lexsort((docs, at))
    at, docs, hashes = at[order], docs[order], hashes[order]
    cut = _starts(at)
    rows: list[tuple] = []
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        run = _starts(docs[a:b])
        rows.append((int(at[a]), lost, docs[a:b][run].tobytes(), np.diff(np.append(run, b - a)).astype(np.uint32).tobytes(), hashes[a:b].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACK.types, strict=True)], schema=_PACK)


def _unpacked(docs: bytes, runs: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(runs, np.uint32)), np.frombuffer(hashes, np.uint64)


def _contest(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(documents, hashes) that stay, one document a hash, and (documents, hashes) that lose."""
    order = np.lexsort((docs, hashes))
    docs, hashes = docs[order], hashes[order]
    start = _starts(hashes)
    least = np.repeat(docs[start], np.diff(np.append(start, len(docs))))
    lose = docs > least
    lose[1:] &= (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[start], hashes[start], docs[lose], hashes[lose]


def _hashed(width: int, buckets: int, groups: int):
    """Windows of whole texts, combined FLUSH at a time."""

    def flush(docs: list[np.ndarray], hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        stay, h, lose, g = _contest(np.concatenate(docs), np.concatenate(hashes))
        yield _pack(stay, h, ((h >> tokens.U(32)) * tokens.U(buckets) >> tokens.U(32)).astype(np.int32), False)
        if len(lose):
            yield _pack(lose, g, _group(lose, groups), True)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0
        for batch in batches:
            texts, ids = common.text_column(batch, "text"), batch.column("doc_id").to_numpy()
            for a, b, data, bounds in tokens.chunks(texts):
                h, first = windows(data, bounds, width)
                of = np.repeat(ids[a:b], np.diff(first))
                for at in range(0, len(h), FLUSH):  # a very long text goes on in parts
                    docs.append(of[at : at + FLUSH])
                    hashes.append(h[at : at + FLUSH])
                    held += len(docs[-1])
                    if held >= FLUSH:
                        yield from flush(docs, hashes)
                        docs, hashes, held = [], [], 0
        if held:
            yield from flush(docs, hashes)

    return emit


def _counted(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """What documents lose, by group. Rows come in the order of their buckets; those already lost pass on."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    lost: list[tuple[np.ndarray, np.ndarray]] = []
    now, count = None, 0

    def settle() -> None:
        nonlocal held, count
        if held:
            _, _, docs, hashes = _contest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            lost.append((docs, hashes))
            count += len(docs)
            held = []

    def hand_on() -> Iterator[pa.RecordBatch]:
        nonlocal lost, count
        docs, hashes = (np.concatenate(x) for x in zip(*lost, strict=True)) if lost else (np.empty(0, np.int64),) * 2
        lost, count = [], 0
        if len(docs):
            yield _pack(docs, hashes, _group(docs, groups), True)

    for batch in batches:
        passing = batch.column("lost")
        yield batch.filter(passing)
        own = batch.filter(pc.invert(passing))
        for at, *part in zip(*(own.column(c).to_pylist() for c in ("at", "docs", "runs", "hashes")), strict=True):
            if at != now:
                settle()
                now = at
                if count >= FLUSH:
                    yield from hand_on()
            held.append(_unpacked(*part))
    settle()
    yield from hand_on()


def kept_words(text: str, lost: np.ndarray | None, width: int) -> tuple[list[bytes], np.ndarray | None]:
    """The text's words and which of them stay (None: all), where windows with hashes in lost go."""
    raw = text.encode()
    parts = raw.split()
    if lost is None or not len(lost):
        return parts, None
    hashes, _ = windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), width)
    hit = np.flatnonzero(np.isin(hashes, lost))
    edge = np.zeros(len(parts) + 1, np.int64)
    edge[hit] += 1
    np.add.at(edge, hit + width, -1)
    return parts, np.cumsum(edge[:-1]) == 0


def removal(docs: DataFrame, width: int = 13) -> DataFrame:
    """Removes from every text the words that a window repeated from a smaller doc_id covers.

    Returns docs' rows with `n_words` and `n_removed` (long), `kept` (the words that stay,
    joined by one space) and `kept_sha256`. A null text has no words; a null doc_id takes
    no part and keeps all its words; rows with one doc_id are one document's and take
    nothing from each other. Other columns of docs pass through, whatever their names;
    those named like the four new ones are replaced. An empty table gives no rows.
    """
    rest = docs.drop("n_words", "n_removed", "kept", "kept_sha256")
    names, at = rest.columns, common.free(rest, "at")
    known = rest.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = common.extent(known)[1]
    # groups and buckets follow the data; a partition holds one or several, one after another
    parts = common.pieces(docs.sparkSession, size, PIECE_BYTES)
    n = max(parts, -(-size // PIECE_BYTES))
    packed = known.mapInArrow(common.tidy(_hashed(width, BUCKETS * n, n)), _PACK_DDL)
    lost = packed.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(common.tidy(lambda batches: _counted(batches, n)), _PACK_DDL)

    def settle(texts: pa.Table | pa.RecordBatch, gone: pa.Table | None) -> pa.Table:
        losses: dict[int, list[np.ndarray]] = {}
        gone = gone if gone is not None else _PACK.empty_table()
        for part in zip(*(gone.column(c).to_pylist() for c in ("docs", "runs", "hashes")), strict=True):
            ids, runs, hashes = (np.frombuffer(x, t) for x, t in zip(part, (np.int64, np.uint32, np.uint64), strict=True))
            for doc, h in zip(ids.tolist(), np.split(hashes, np.cumsum(runs)[:-1]), strict=True):
                losses.setdefault(doc, []).append(h)
        n_words, n_removed, kept, sha = [], [], [], []
        for doc, text in zip(texts.column("doc_id"), texts.column("text"), strict=True):
            own = losses.get(doc.as_py())
            parts, stay = kept_words(text.as_py() or "", None if own is None else np.concatenate(own), width)
            left = parts if stay is None else [w for w, s in zip(parts, stay.tolist(), strict=True) if s]
            line = b" ".join(left)
            n_words.append(len(parts))
            n_removed.append(len(parts) - len(left))
            kept.append(line)
            sha.append(hashlib.sha256(line).hexdigest())
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())]
        common.give_back()
        return pa.table([*(texts.column(c) for c in names), *new], names=[*names, "n_words", "n_removed", "kept", "kept_sha256"])

    out = common.schema_with(rest, n_words=T.LongType(), n_removed=T.LongType(), kept=T.StringType(), kept_sha256=T.StringType())
    grouped = rest.where("doc_id is not null").withColumn(at, (F.crc32(F.col("doc_id").cast("long").cast("string")) % n).cast("int"))
    settled = grouped.groupBy(at).cogroup(lost.groupBy("at")).applyInArrow(settle, out)
    # rows without a doc_id lose nothing, so they meet nothing
    alone = rest.where("doc_id is null").mapInArrow(lambda batches: (b for batch in batches if len(batch) for b in settle(batch, None).to_batches()), out)
    return settled.unionByName(alone)
