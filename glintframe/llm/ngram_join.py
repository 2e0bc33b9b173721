"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

The matrix has a row for each distinct set of word shingles (equal sets share one)
and a column for each shingle, a 64-bit hash. Columns stand in one order: shingles
that a sample shows to be frequent come last, the more frequent the later, and all
others by hash. The order bears on work only, never on results.

1. The product runs over the first columns of each row. Linked rows of n entries share
   one of their first n - ceil(t n) + 1 entries, so no link is missed. The hash deals
   columns out to blocks; a block's task multiplies its columns and adds up, for each
   pair of rows, the overlap there. Sums over the blocks give a pair's overlap in the
   first columns; what is left of either row bounds the rest. Pairs that can't reach
   the overlap that their sizes need are discarded.
2. Of the remaining pairs, each row's best and then those across components are
   multiplied over all columns, which gives their overlap exactly.

A column of more than SMALL rows is split from its block. Near copies with few changes
of their own have most large columns and are linked with most, so in the column that it
shares with most rows each row first meets the row that has most: one pair a row, which
joins groups of near copies at a cost linear in their size. Then rows outside a column's
largest component meet the row of it that has most large columns. At last all rows in different components meet in a join on the column, where
sizes bound how many columns linked rows share and so which of them need be looked at. No
component is missed, and copies of copies are not expanded into all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm import common, tokens
from glintframe.llm.components import components

#: Sampled documents, frequent shingles kept (at 16 bytes).
SAMPLE, FREQUENT = 32_768, 262_144
#: Rows of a column that is multiplied within its block.
SMALL = 16
#: Up to so many doc_ids (8 bytes each) are broadcast to find their texts; beyond, texts are shuffled to them.
BROADCAST_IDS = 1_000_000
#: Entries that a map task packs at once; bytes of text for each block of columns.
ROWS_A_FLUSH, BLOCK_BYTES = 1 << 19, 8 << 20


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a chunk."""
    hashes, of = tokens.words(data, bounds, lower=True)
    rolled = tokens.rolling(hashes, words)
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:  # the whole sequence is one shingle
            yield tokens.mix(tokens.rolling(hashes[a:b], b - a) + tokens.U(b - a))
        else:
            yield np.empty(0, np.uint64)


def needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int):
    return n + (percent * n) // -100 + 1


def suffix(n: Column, percent: int) -> Column:
    """Entries of a row of n behind its first columns."""
    return F.ceil(n * percent / F.lit(100)).cast("long") - 1


def enough(overlap: Column, percent: int) -> Column:
    """Whether rows of sizes n_a and n_b with that overlap in the first columns can be linked.

    The first columns of one row end before those of the other; past that end it has only its suffix to share.
    """
    rest = F.greatest(suffix(F.col("n_a"), percent), suffix(F.col("n_b"), percent))
    return (overlap + rest) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def frequent_shingles(docs: DataFrame, n: int, words: int) -> np.ndarray:
    """Hashes of the shingles that occur in 3 or more of about SAMPLE of the n documents, rarest first; at most FREQUENT."""
    some = docs.where(common.hashed_share(F.col("doc_id"), "ngram order", min(1.0, SAMPLE / max(n, 1))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in tokens.chunks(common.text_column(batch, "text")):
                sets = list(shingle_sets(data, bounds, words))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    counted = some.select("text").mapInArrow(common.tidy(emit), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3")
    rows = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    return rows.column("h").to_numpy()[::-1].copy().view(np.uint64)


def _incidence(docs: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, t (a hash of the text), n, set (128-bit digest), first (hashes of the first columns, in order)."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int32)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            texts, ids = common.text_column(batch, "text"), batch.column("doc_id")
            for at, to, data, bounds in tokens.chunks(texts):
                n, digest, first = [], [], []
                for h in shingle_sets(data, bounds, words):
                    n.append(len(h))
                    if not len(h):
                        digest.append(None)
                        first.append(None)
                        continue
                    digest.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    p = prefix_length(len(h), percent)
                    if len(known):
                        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        often = known[place] == h
                        rare = h[~often][:p]
                        if len(rare) < p:
                            hot = h[often]
                            rare = np.concatenate([rare, hot[np.argsort(rank[place[often]])][: p - len(rare)]])
                        first.append(rare.tobytes())
                    else:
                        first.append(h[:p].tobytes())
                yield pa.RecordBatch.from_arrays([ids[at:to], batch.column("t")[at:to], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.binary())], ["doc_id", "t", "n", "set", "first"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(common.tidy(emit), "doc_id long, t long, n long, set binary, first binary")


_PACKED = pa.schema([("block", pa.int32()), ("row", pa.binary()), ("n", pa.binary()), ("h", pa.binary())])


def _columns(blocks: int):
    """Packs the first columns' entries (row, size, hash) by block of columns."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        row, n, h = (np.concatenate(x) for x in zip(*held, strict=True))
        block = (h % tokens.U(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        cut = np.flatnonzero(np.concatenate([np.ones(1, bool), block[1:] != block[:-1]]))
        parts = [np.split(x[order], cut[1:]) for x in (row, n, h)]
        return pa.RecordBatch.from_arrays([pa.array(block[cut]), *(pa.array([p.tobytes() for p in x], pa.binary()) for x in parts)], schema=_PACKED)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for row, n, first in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "first")), strict=True):
                h = np.frombuffer(first, np.uint64)
                for a in range(0, len(h), ROWS_A_FLUSH):
                    part = h[a : a + ROWS_A_FLUSH]
                    held.append((np.full(len(part), row, np.int64), np.full(len(part), n, np.int32), part))
                    count += len(part)
                    if count >= ROWS_A_FLUSH:
                        yield flush(held)
                        held, count = [], 0
        if count:
            yield flush(held)

    return emit


_PRODUCT = "a long, b long, n_a long, n_b long, overlap int, h long"


def _multiplied(h: np.ndarray, row: np.ndarray, n: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """A block's product: (a, b, sizes, overlap) of pairs of rows; of columns of more than SMALL rows their entries (a, n_a, h)."""
    order = np.lexsort((row, n, h))
    h, row, n = h[order], row[order], n[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), h[1:] != h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    large = np.repeat(size > SMALL, size)
    ids, of = np.unique(row, return_inverse=True)
    size_of = np.empty(len(ids), np.int64)
    size_of[of] = n
    keys: list[np.ndarray] = []
    for k in range(1, SMALL):
        i = np.flatnonzero((h[k:] == h[:-k]) & ~large[k:])
        if not len(i):
            break
        i = i[n[i] * 100 >= n[i + k] * percent]  # a column's rows stand by size
        i, j = of[i], of[i + k]
        keys.append(np.minimum(i, j) * len(ids) + np.maximum(i, j))
    names = ["a", "b", "n_a", "n_b", "overlap", "h"]
    pairs, overlap = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.empty(0, np.int64),) * 2
    for at in range(0, len(pairs), 1 << 16):
        a, b = np.divmod(pairs[at : at + (1 << 16)], len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(size_of[a]), pa.array(size_of[b]), pa.array(overlap[at : at + (1 << 16)].astype(np.int32)), pa.nulls(len(a), pa.int64())], names)
    if large.any():
        m = int(large.sum())
        none = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(row[large]), none, pa.array(n[large]), none, pa.nulls(m, pa.int32()), pa.array(h[large].view(np.int64))], names)


def _product(percent: int):
    """One block a partition, or several one after another."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"h": np.uint64, "row": np.int64, "n": np.int32}
        got: dict[str, list] = {c: [] for c in kinds}
        now = None
        for batch in batches:
            for block, *part in zip(*(batch.column(c).to_pylist() for c in ("block", *kinds)), strict=True):
                if block != now and got["h"]:
                    yield from _multiplied(*(np.concatenate(x) for x in got.values()), percent)
                    got = {c: [] for c in kinds}
                now = block
                for c, x in zip(kinds, part, strict=True):
                    got[c].append(np.frombuffer(x, kinds[c]))
        if got["h"]:
            yield from _multiplied(*(np.concatenate(x) for x in got.values()), percent)

    return emit


def _named(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id ids (row: distinct) holds."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(few, docs["doc_id"] == few["row"], "left_semi")


def _sets(texts: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(row, hashes) of the whole sets of documents; of those that share a doc_id, of the text that stands for it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("doc_id")
            for at, to, data, bounds in tokens.chunks(common.text_column(batch, "text")):
                sets = [h.tobytes() for h in shingle_sets(data, bounds, words)]
                yield pa.RecordBatch.from_arrays([rows[at:to], pa.array(sets, pa.binary())], ["row", "hashes"])

    if repeated:
        texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return texts.select("doc_id", "text").mapInArrow(common.tidy(emit), "row long, hashes binary")


def _linked(pairs: DataFrame, texts: DataFrame, words: int, percent: int, repeated: bool) -> DataFrame:
    """Pairs (a, b) whose overlap over all columns is enough."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("hashes_a"), batch.column("hashes_b"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                ok.append(int((both[1:] == both[:-1]).sum()) >= needed(len(p), len(q), percent))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    pairs = common.written(pairs)
    ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    ids = common.written(ids)
    sets = common.written(_sets(_named(texts, ids), words, repeated))
    side = lambda c: sets.select(F.col("row").alias(c), F.col("hashes").alias(f"hashes_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "hashes_a", "hashes_b")
    out = common.written(met.mapInArrow(common.tidy(emit), "a long, b long"))
    common.discard(pairs, ids, sets)
    return out


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose rows are not in one component so far."""
    side = lambda c: groups.select(F.col("id").alias(c), F.col("component").alias(f"component_{c}"))
    known = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return known.where(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).drop("component_a", "component_b")


def _placed(large: DataFrame) -> DataFrame:
    """Entries of large columns (h, row, n) with k, the row's number of them, and r, this one's rank among them: columns of few rows first."""
    rows = large.groupBy("h").agg(F.count("*").alias("m"))
    one = Window.partitionBy("row")
    placed = large.join(rows, "h").withColumn("r", F.row_number().over(one.orderBy("m", "h"))).withColumn("k", F.count("*").over(one))
    return placed.select("h", "row", "n", "r", "k")


def _seeds(large: DataFrame, percent: int) -> DataFrame:
    """(a, b): each row with the one that has most large columns, in its own column of most rows."""
    hubs = large.groupBy("h").agg(F.max(F.struct("k", "row", "n")).alias("y"))
    met = large.where("r = k").join(hubs, "h").where("row != y.row").where(F.least("n", "y.n") * 100 >= F.greatest("n", "y.n") * percent)
    return met.select(F.least("row", "y.row").alias("a"), F.greatest("row", "y.row").alias("b"))


def _across(large: DataFrame, groups: DataFrame, percent: int, hubs: bool = False) -> DataFrame:
    """Pairs (a, b) of rows that share large columns, are in different components so far and can be linked.

    Linked rows share at least `least` of their first columns, so of large ones that they share the one with the
    fewest rows has least - 1 behind it in the order of either row; if they share none, a small one shows them.
    hubs: only pairs with that row of a column's largest component that has the most large columns.
    """
    named = large.join(groups.withColumnRenamed("id", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    counts = named.groupBy("h", "component").agg(F.count("*").alias("m"))
    main = counts.groupBy("h").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    open_ = named.join(main, "h")
    other = open_
    if hubs:
        hub = F.max(F.struct("k", "row", "n", "r", "component")).alias("y")
        other = open_.where("component = main").groupBy("h", "main").agg(hub).select("h", "main", "y.k", "y.row", "y.n", "y.r", "y.component")
    x, y = open_.where("component != main").alias("x"), other.alias("y")
    c = lambda s: F.col(s)
    sizes = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    least = F.ceil((c("x.n") + c("y.n")) * percent / F.lit(100 + percent)) - F.greatest(suffix(c("x.n"), percent), suffix(c("y.n"), percent))
    early = (c("x.r") + least <= c("x.k") + 1) & (c("y.r") + least <= c("y.k") + 1)
    once = (c("y.component") == c("y.main")) | (c("x.row") < c("y.row"))
    met = x.join(y, (c("x.h") == c("y.h")) & (c("x.component") != c("y.component")) & once & sizes & early)
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def _rows(whole: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of an incidence table: its rows with `chosen` (whether one stands for its doc_id), the matrix's rows (set, row, n, first), and a table of doc_ids that repeat."""
    twice = common.written(whole.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), F.min("t").alias("t0")).where("k > 1").drop("k"))
    marked = whole.join(twice, "doc_id", "left").withColumn("chosen", F.expr("doc_id is not null and set is not null and (t0 is null or t = t0)"))
    some = F.min(F.struct("doc_id", "n", "first"))
    rows = marked.where("chosen").groupBy("set").agg(some.alias("r")).select("set", F.col("r.doc_id").alias("row"), "r.n", "r.first")
    return marked, rows, twice


def joined(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every document of (doc_id, text).

    Words are runs of other than ASCII white space, A-Z lower-cased, of whole texts of any
    length. Two documents link when 100 * intersection >= percent * union of their sets of
    `words`-word shingles; a shorter text is one shingle; null and empty texts, and rows
    without a doc_id, link with nothing. component_id is the smallest doc_id reachable.
    Each input row gives a row; of rows that share a doc_id but not the text, one stands
    for the document. Other columns of docs, whatever their names, play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = texts.where("doc_id is not null and text is not null")
    n, size = common.extent(full)
    whole = common.written(_incidence(texts, frequent_shingles(full, n, words), words, percent))
    members, rows, twice = _rows(whole)
    repeated = not twice.isEmpty()
    blocks = common.pieces(docs.sparkSession, size, BLOCK_BYTES)
    packed = rows.select("row", "n", "first").mapInArrow(common.tidy(_columns(blocks)), "block int, row binary, n binary, h binary")
    product = common.written(packed.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(common.tidy(_product(percent)), _PRODUCT))
    large = product.where("b is null").select("h", F.col("a").alias("row"), F.col("n_a").alias("n"))
    sums = product.where("b is not null").groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    sums = common.written(sums)
    # entries in large columns, whose overlaps are not in the sums
    large = common.written(_placed(large))
    more = large.where("r = 1").select("row", "k")
    side = lambda c: more.select(F.col("row").alias(c), F.col("k").alias(f"k_{c}"))
    both = sums.join(side("a"), "a", "left").join(side("b"), "b", "left")
    unseen = F.least(F.coalesce("k_a", F.lit(0)), F.coalesce("k_b", F.lit(0)))
    passing = common.written(both.where(enough(F.col("overlap") + unseen, percent)).select("a", "b", "overlap"))
    # each row with the partner of its largest overlap
    ends = passing.select(F.col("a").alias("row"), "a", "b", "overlap").union(passing.select("b", "a", "b", "overlap"))
    best = ends.groupBy("row").agg(F.max_by(F.struct("a", "b"), F.struct("overlap", "a", "b")).alias("p")).select("p.a", "p.b")
    exact = lambda pairs: _linked(pairs.select("a", "b").distinct(), full, words, percent, repeated)
    edges = lambda g: g.select(F.col("id").alias("a"), F.col("component").alias("b"))
    first = exact(best.union(_seeds(large, percent)))
    groups = common.written(components(first))
    second = exact(_apart(passing.select("a", "b"), groups).union(_across(large, groups, percent, hubs=True)))
    merged = common.written(components(edges(groups).union(second)))
    third = exact(_across(large, merged, percent))
    # equal sets are stars around their row
    named = members.where("chosen").select("doc_id", "set")
    same = named.join(named.groupBy("set").agg(F.min("doc_id").alias("row")), "set").where("doc_id != row").select(F.col("doc_id").alias("a"), F.col("row").alias("b"))
    final = components(edges(merged).union(third).union(same)).withColumnRenamed("id", "doc_id")
    common.discard(product, large, sums, passing, first, groups, second, merged, third)
    out = members.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id stay.

    Of rows that share a doc_id, all stay or all go. Columns of docs pass through, whatever their names.
    """
    keep = common.free(docs, "keep")
    groups = joined(docs, words, percent).where("doc_id = component_id").select(F.col("doc_id").alias(keep)).distinct()
    return docs.join(groups, docs["doc_id"].cast("long") == groups[keep], "left_semi").unionByName(docs.where("doc_id is null"))
