"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of `window` words, or the whole item if it has fewer. Windows of
equal words are one. A window's set is its shingles of `shingle` words (of all its words, if it
has fewer). It occurs in a text only if all of its shingles do, so with shingles ordered by
rarity in the texts its prefix is one shingle, the rarest; no other has to be joined.

1. Shingles of the texts meet the benchmark's: text, position, shingle of those found.
2. Their counts order each window's shingles; a window with a shingle that no text has is dropped.
3. Windows join the found shingles on their prefix. Its place in the window gives the place of
   the window in the text: before the first word or beyond the last it is discarded.
4. What is left is compared word by word in the text.

Texts stand by their 128-bit digest, so equal texts are one group after a map-side combine.
The join with the texts is an ordinary one on the digest, which adaptive execution splits
where one text has many rows. The benchmark's shingles are broadcast only if they are at most
BROADCAST; else they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm import common

#: Rows of benchmark shingles (8 bytes and a size each) or prefixes that are broadcast at most.
BROADCAST = 200_000


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("string")))


def shingle_at(words: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from position `at` (from 0)."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def shingles(rows: DataFrame, words: str, size: int, *keep: str) -> DataFrame:
    """keep, at (from 0) and h of every shingle of that size in the column `words`."""
    hashes = F.transform(F.col(words), lambda _, i: F.when(i + size <= F.size(words), shingle_at(F.col(words), i, size)))
    # outer, as for an inner explode Spark would compute the hashes once more in a filter for empty arrays
    each = rows.select(*keep, F.slice(hashes, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))).alias("hashes"))
    return each.select(*keep, F.posexplode_outer("hashes").alias("at", "h")).where("h is not null")


def windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id as string, window: its words) for each item and each of its windows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), common.plain_words(F.col("text")).alias("words")).where("words is not null")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, window))).alias("window")).distinct()


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def covered(places: Column) -> Column:
    """Number of words in the union of sorted places (at, size)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, p: Column) -> Column:
        end = p["at"] + p["size"]
        new = F.greatest(end - F.greatest(acc["end"], p["at"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(places, start, add, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """Columns of docs and n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window. n_items counts the items with a window
    that occurs; items_sha256 is the SHA-256 of their ids, sorted as strings and joined by commas
    (of the empty string if there are none). A null or wordless text has no words and no hits; an
    item without words has no window; items that share an id count once, those without an id not
    at all, though their words are hit. Rows with equal texts have equal results. Whole texts are
    read, of any length. Columns of docs named like the new ones are replaced.
    """
    key, words, found = (common.free(docs, c) for c in ("key", "words", "found"))
    new = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kept = [c for c in docs.columns if c.lower() not in new]

    item_windows = common.written(windows(benchmark, window))
    distinct = item_windows.select("window").distinct().withColumn("size", F.least(F.size("window"), F.lit(shingle)))
    sizes = sorted(r["size"] for r in distinct.select("size").distinct().collect())  # at most `shingle` of them
    each = [shingles(distinct.where(F.col("size") == k), "window", k, "window", "size") for k in sizes]
    parts = docs.sparkSession.createDataFrame([], "window array<string>, size int, at int, h long")
    for e in each:
        parts = parts.union(e)
    parts = common.written(parts)  # (window, size, at, h): the shingles of each window

    wanted = small(parts.select("h").distinct(), BROADCAST)
    texts = docs.select(digest(F.col("text")).alias("key"), common.plain_words(F.col("text")).alias("words")).where("words is not null").withColumn("n", F.size("words"))
    met = docs.sparkSession.createDataFrame([], "key binary, n int, at int, h long")
    for k in sizes:
        met = met.union(shingles(texts, "words", k, "key", "n").join(wanted, "h", "left_semi").select("key", "n", "at", "h"))
    met = common.written(met)

    counts = met.groupBy("h").agg(F.count("*").alias("rarity"))
    ordered = parts.join(counts, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("rarity", F.lit(0)).alias("rarity"), "h", "at")).alias("least"))
    prefixes = common.written(ordered.where("least.rarity > 0").select(F.col("least.h").alias("h"), F.col("least.at").alias("offset"), "window"))
    candidates = met.join(small(prefixes, BROADCAST), "h").withColumn("at", F.col("at") - F.col("offset"))
    candidates = candidates.where((F.col("at") >= 0) & (F.col("at") + F.size("window") <= F.col("n")))
    # written, so that the join below has an exchange of its own, whose hot texts adaptive execution splits
    by_text = common.written(candidates.groupBy("key").agg(F.collect_set(F.struct("at", "window")).alias("candidates")))

    rows = docs.select(*kept, digest(F.col("text")).alias(key))
    joined = rows.join(by_text.withColumnsRenamed({"key": key, "candidates": found}), key, "left").withColumn(words, common.plain_words(F.col("text")))
    true = F.filter(found, lambda c: F.slice(F.col(words), c["at"] + 1, F.size(c["window"])) == c["window"])
    judged = joined.withColumn(found, F.when(F.col(found).isNotNull(), F.sort_array(F.transform(true, lambda c: F.struct(c["at"].alias("at"), F.size(c["window"]).alias("size"), c["window"].alias("window"))))))
    judged = judged.withColumns({
        "n_words": F.coalesce(F.size(words), F.lit(0)).cast("long"),
        "n_hit": F.coalesce(covered(F.col(found)), F.lit(0)).cast("long"),
        found: F.array_distinct(F.transform(found, lambda c: c["window"])),
    })
    judged = common.written(judged.drop(words))

    hit = judged.where("n_hit > 0").select(F.col(key).alias("key"), F.explode(found).alias("window")).distinct()
    items = hit.join(item_windows.where("item_id is not null"), "window").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    digests = common.written(items.select(F.col("key").alias(key), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")))
    out = judged.join(digests, key, "left")
    return out.select(*kept, "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
