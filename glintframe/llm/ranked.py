"""Ranked lexical search with a tree of maxima over document ranges.

1. Items go in blocks of about BLOCK terms, so what is broadcast is bounded; a block is one pass.
2. Each document becomes its terms out of the block's vocabulary with their counts. Nothing is
   keyed by term or document, so no hot term or copy meets in one task.
3. Counts of documents, of terms and by term give the weights; of these the driver gets one number
   a term of the block.
4. A task takes documents in batches. Ranges of FAN documents, of FAN such ranges and so on hold
   for each term the highest score that it gives to a document within. An item's search opens
   the range with the highest sum over its terms first and ends where that is below the k-th
   best score so far; a range just equal to it is opened too, as it may hold a smaller doc_id
   of the same score. Best scores stay from batch to batch.
5. The tasks' best k of each item meet in a ranking by window, which Spark cuts to k before the shuffle, too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm import common

#: Terms of the items of a block, about.
BLOCK = 50_000
#: Documents of a range, and ranges of the next.
FAN = 16
NO_ID = 1 << 63  # stands behind every doc_id


@dataclass(frozen=True)
class Level:
    """Nodes' terms and highest scores: those of node i are at start[i] to start[i + 1], by term."""

    start: np.ndarray
    term: np.ndarray
    score: np.ndarray

    def nodes(self) -> int:
        return len(self.start) - 1

    def sums(self, a: int, b: int, asked: np.ndarray) -> np.ndarray:
        """Sums over the asked terms of the nodes from a to b."""
        at, to = self.start[a], self.start[b]
        upto = np.zeros(to - at + 1, np.int64)
        np.cumsum(np.where(asked[self.term[at:to]], self.score[at:to], 0), out=upto[1:])
        return upto[self.start[a + 1 : b + 1] - at] - upto[self.start[a:b] - at]


def tree(leaves: Level, terms: int) -> list[Level]:
    """Levels from the documents up to a single range."""
    levels = [leaves]
    while (below := levels[-1]).nodes() > 1:
        n = -(-below.nodes() // FAN)
        key = np.repeat(np.arange(below.nodes()) // FAN, np.diff(below.start)) * terms + below.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        best = np.maximum.reduceat(below.score[order], first) if len(first) else below.score
        levels.append(Level(np.searchsorted(key[first], np.arange(n + 1) * terms), key[first] % terms, best))
    return levels


def search(levels: list[Level], asked: np.ndarray, ids: list[int], best: list[tuple[int, int]], k: int) -> None:
    """Brings the batch's documents into best, a heap of up to k (score, -doc_id)."""
    top = len(levels) - 1
    queue = [(-int(b), top, i) for i, b in enumerate(levels[top].sums(0, levels[top].nodes(), asked).tolist())]
    while queue:
        bound, level, node = heapq.heappop(queue)
        least = best[0][0] if len(best) == k else 1
        if -bound < least:
            return
        if level:
            below, a = levels[level - 1], node * FAN
            sums = below.sums(a, min(a + FAN, below.nodes()), asked)
            for i in np.flatnonzero(sums >= least).tolist():
                heapq.heappush(queue, (-int(sums[i]), level - 1, a + i))
        elif len(best) < k:
            heapq.heappush(best, (-bound, -ids[node]))
        else:
            heapq.heappushpop(best, (-bound, -ids[node]))


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document with a term: n terms with repeats, and those of the vocabulary, by number."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            words = batch.column("words")
            n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = words.flatten()
            term = pc.index_in(flat if pa.types.is_string(flat.type) else flat.cast(pa.string()), value_set=known)
            here = term.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)[here]
            key, times = np.unique(row * len(known) + term.drop_null().to_numpy().astype(np.int64), return_counts=True)
            start = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(start, pa.array(v, pa.int32())) for v in (key % max(len(known), 1), times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.plain_words(F.col("text")).alias("words")).where("words is not null")
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


def _of_block(docs: DataFrame, items: list[tuple[str | None, list[str]]], k: int) -> DataFrame | None:
    vocabulary = sorted({t for _, terms in items for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    found = common.written(postings(docs, vocabulary))
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.log((F.lit(2.0 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")) * 1000.0)
    weights = np.zeros(len(vocabulary), np.int64)
    for r in holding.select("term", weight.alias("w")).collect():  # at most one row a term of the block
        weights[r["term"]] = r["w"]
    asked = [np.array([number[t] for t in terms], np.int64) for _, terms in items]
    sent = docs.sparkSession.sparkContext.broadcast(([i for i, _ in items], asked, weights))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, weights = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        mask = np.zeros(len(weights), bool)
        for batch in batches:
            if not len(batch):
                continue
            terms, counts = batch.column("terms"), batch.column("counts").flatten().to_numpy().astype(np.int64)
            n = terms.value_lengths().to_numpy(zero_copy_only=False)
            term = terms.flatten().to_numpy().astype(np.int64)
            m = np.repeat(batch.column("m").to_numpy(zero_copy_only=False), n)
            score = weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))
            levels = tree(Level(np.concatenate([[0], np.cumsum(n)]), term, score), len(weights))
            ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            for own, heap in zip(asked, best, strict=True):
                mask[own] = True
                search(levels, mask, ids, heap, k)
                mask[own] = False
        for i, heap in enumerate(best):
            if heap:
                docs_ = [None if d == -NO_ID else -d for _, d in heap]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(heap), pa.int32()), pa.array([names[i]] * len(heap), pa.string()), pa.array(docs_, pa.int64()), pa.array([s for s, _ in heap], pa.int64())], ["item", "item_id", "doc_id", "score"])

    # decimals, as 50 * n * N may pass 64 bits where the quotient doesn't
    m = F.expr(f"50L + (cast(50L * n as decimal(19,0)) * cast({n_docs}L as decimal(19,0))) div cast({n_terms}L as decimal(38,0))")
    scored = found.where(F.size("terms") > 0).select("doc_id", "terms", "counts", m.alias("m"))
    each = scored.mapInArrow(best_of, "item int, item_id string, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k documents of the highest score above 0, ties by ascending doc_id.

    The score is a sum of whole numbers over the item's different terms: of the term's weight
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))) times (10^9 * tf) div (1000 * tf + 20 * m), where m is
    50 + (50 * n * N) div L; N documents have L terms, n of them this one, and df documents hold the term.
    Null texts and texts without terms are no documents, items without terms find nothing. Rows
    that share a doc_id are ranked one by one, those without one stand behind their ties. Items of
    one id and the same terms are one item; items of one id and other terms are ranked each by
    itself. Whole texts are read, of any length. An empty table on either side gives no rows.
    Other columns of docs and items play no part.
    """
    kind = items.schema["item_id"].dataType
    terms = F.sort_array(F.array_distinct(common.plain_words(F.col("text"))))
    asking = items.select(F.col("item_id").cast("string").alias("item_id"), terms.alias("terms")).where("terms is not null").distinct()
    asking = common.written(asking)
    entries = asking.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    out = docs.sparkSession.createDataFrame([], "item_id string, rank int, doc_id long, score long")
    blocks = -(-entries // BLOCK)
    for b in range(blocks):
        own = asking.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).orderBy("item_id", "terms").collect()  # about BLOCK terms
        found = _of_block(docs, [(r["item_id"], r["terms"]) for r in own], k) if own else None
        out = out if found is None else out.unionByName(found)
    return out.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
