"""URL filters: explicit host and path rules, and association rules for what they leave open.

Spark's FP-growth mines combinations of URL tokens of any length from labelled URLs. Three
reductions, none of which changes a verdict, keep what it mines from small:

* tokens that always occur together are one group, and a rule over groups holds for a URL that
  has a token of each, so a long path that occurs twice is one item;
* a group whose URLs all have one label makes a rule that no larger set can better, and leaves the
  baskets;
* baskets that still hold over LONG groups are split by conditional passes: one for each group, over
  the URLs that have it, with more frequent groups only, less those that all of these URLs have.

Of frequent sets those with a smaller set of the same URLs are dropped before anything is
collected. Rules are pruned by support and confidence. To judge a URL, an inverted index from
tokens to groups and rules counts how many groups of each rule the URL has; of the rules that
are whole, the most confident one decides.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm import common

#: Least share of the labelled URLs and least number of them, least confidence.
SUPPORT, LEAST, CONFIDENCE = 0.01, 2, 0.6
#: Groups of a basket that FP-growth takes; it may make 2 to that power sets of one.
LONG = 10
#: Labelled URLs to mine from, about; of more, a sample fixed by a hash of the URL.
SAMPLE = 1_000_000
DEFAULT = "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host, then path from its first slash

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), common.UPPER, common.LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, parts of the path (digits as one #), keys of the query, a fragment's presence."""
    some = lambda parts: F.filter(parts, lambda p: p != "")
    host = F.transform(some(F.split(host_of(url), "\\.")), lambda x: F.concat(F.lit("h:"), x))
    path = F.transform(some(F.split(path_of(url), "/")), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.transform(some(F.split(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), "&")), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.when(F.regexp_extract(url, "://[^#]*(#)", 1) == "#", F.array(F.lit("f:#"))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.concat(host, path, query, fragment))).otherwise(none)


def explicit(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it and starts the path; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Mined:
    """Rules, best first: groups and label. rank is equal for rules that only their tokens' text sets apart."""

    groups: dict[str, list[int]]  # of each token
    rules: list[tuple[tuple[int, ...], str]]
    rank: list[int]
    index: dict[int, list[int]]  # from groups to rules


class _Found:
    """Groups and rules found so far. The driver holds one entry for each frequent (context, item) and each rule."""

    def __init__(self, fewest: int, confidence: float) -> None:
        self.fewest, self.confidence = fewest, confidence
        self.tokens: list[list[str]] = []  # of each group
        self.count: list[int] = []  # labelled URLs of each group, within its context
        self.contexts: list[tuple[int, ...]] = [()]
        self.rules: list[tuple[float, int, tuple[int, ...], str]] = []

    def grouped(self, stats: DataFrame, tokens_of_item: Callable[[object], list[str]]) -> list[tuple[int, object, int]]:
        """(context, item, group) of the items whose groups have several labels; the rules of each group are taken."""
        alike: dict[tuple, list] = defaultdict(list)
        for r in stats.collect():
            alike[r["ctx"], r["n"], r["a"], r["b"]].append(r)
        mixed = []
        for (ctx, n, *_), rows in alike.items():
            context = self.contexts[ctx]
            if context and n == self.count[context[-1]]:
                continue  # all of the context's URLs have it
            group = len(self.tokens)
            self.tokens.append([t for r in rows for t in tokens_of_item(r["item"])])
            self.count.append(n)
            for label, both in rows[0]["labels"]:
                if both >= self.fewest and both / n >= self.confidence:
                    self.rules.append((both / n, both, (*context, group), label))
            if len(rows[0]["labels"]) > 1:
                mixed += [(ctx, r["item"], group) for r in rows]
        return mixed


def _stats(baskets: DataFrame, fewest: int) -> DataFrame:
    """(ctx, item, n, a, b, labels) of the items of baskets (ctx, row, label, items) that have a label often enough; a and b tell sets of rows apart."""
    each = baskets.select("ctx", "row", "label", F.explode("items").alias("item"))
    by = each.groupBy("ctx", "item", "label").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(c), "row")).alias(c) for c in "ab"))
    whole = by.groupBy("ctx", "item").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("labels"))
    return whole.where(F.col("most") >= fewest)


def _baskets(level: DataFrame, mixed: list[tuple[int, object, int]], item: str) -> DataFrame:
    """level's baskets with the groups in place of the items; items without one are left out, baskets without any too."""
    spark = level.sparkSession
    names = spark.createDataFrame(mixed, f"ctx int, item {item}, group int")
    each = level.select("ctx", "row", "label", F.explode("items").alias("item")).join(F.broadcast(names), ["ctx", "item"])
    return common.written(each.groupBy("ctx", "row", "label").agg(F.sort_array(F.collect_set("group")).alias("items")))


def _split(baskets: DataFrame, found: _Found) -> DataFrame:
    """The next level: for each basket and each of its groups the more frequent ones (of equal ones the later), in the context that the group makes."""
    pairs = [(r["ctx"], r["g"]) for r in baskets.select("ctx", F.explode("items").alias("g")).distinct().collect()]
    rows = []
    for ctx, g in sorted(pairs):
        rows.append((ctx, g, len(found.contexts), found.count[g]))
        found.contexts.append((*found.contexts[ctx], g))
    names = baskets.sparkSession.createDataFrame(rows, "ctx int, g int, next int, often int")
    each = baskets.select("ctx", "row", "label", F.explode("items").alias("g")).join(F.broadcast(names), ["ctx", "g"])
    ordered = each.groupBy("ctx", "row", "label").agg(F.sort_array(F.collect_list(F.struct("often", "g", "next"))).alias("l"))
    cut = F.transform("l", lambda x, i: F.struct(x["next"].alias("ctx"), F.transform(F.slice(F.col("l"), i + 2, F.size("l")), lambda y: y["g"]).alias("items")))
    return ordered.select("row", "label", F.explode(cut).alias("c")).select("c.ctx", "row", "label", "c.items")


def _grown(baskets: DataFrame, found: _Found) -> None:
    """Takes the rules of two groups and more that FP-growth finds in baskets (ctx, row, label, items: groups)."""
    rows = baskets.select(F.concat(F.transform("items", lambda g: F.concat_ws(":", F.col("ctx"), g)), F.array(F.concat_ws("=", "ctx", "label"))).alias("items"))
    n = rows.count()
    if not n:
        return
    sets = FPGrowth(itemsCol="items", minSupport=(found.fewest - 0.5) / n).fit(rows).freqItemsets
    group = lambda i: ~F.contains(i, F.lit("=")) | (F.contains(i, F.lit(":")) & (F.instr(i, ":") < F.instr(i, "=")))
    sets = common.written(sets.select(F.sort_array(F.filter("items", group)).alias("set"), F.get(F.filter("items", lambda i: ~group(i)), 0).alias("label"), "freq"))
    plain = sets.where("label is null").select("set", F.col("freq").alias("n"))
    # a set with a smaller one of as many URLs never decides
    less = F.transform("set", lambda _, i: F.concat(F.slice("set", 1, i), F.slice("set", i + 2, F.size("set"))))
    smaller = plain.where(F.size("set") > 1).select(F.col("set").alias("large"), "n", F.explode(less).alias("set"))
    idle = smaller.join(plain.withColumnRenamed("n", "n_less"), "set").where("n = n_less").select(F.col("large").alias("set")).distinct()
    rules = sets.where(F.col("label").isNotNull() & (F.size("set") > 1)).join(plain, "set").where(F.col("freq") / F.col("n") >= found.confidence).join(idle, "set", "left_anti")
    for r in rules.collect():
        ctx = int(r["set"][0].partition(":")[0])
        groups = tuple(int(i.partition(":")[2]) for i in r["set"])
        found.rules.append((r["freq"] / r["n"], r["freq"], (*found.contexts[ctx], *groups), r["label"].partition("=")[2]))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> Mined:
    """Rules that can decide, from (tokens: distinct ones, label); rows without a label are left out.

    Order: confidence, support, fewer tokens, then the tokens' text. Frequent tokens and
    rules reach the driver.
    """
    rows = common.written(labelled.where("label is not null").select(F.lit(0).alias("ctx"), F.monotonically_increasing_id().alias("row"), F.col("label").cast("string").alias("label"), F.col("tokens").alias("items")))
    found = _Found(max(least, math.ceil(support * rows.count())), confidence)
    mixed = found.grouped(_stats(rows, found.fewest), lambda token: [token])
    level, kind = rows, "string"
    while mixed:
        baskets = _baskets(level, mixed, kind)
        longest = baskets.groupBy("ctx").agg(F.max(F.size("items")).alias("size"))
        short = [r["ctx"] for r in longest.where(F.col("size") <= LONG).collect()]
        _grown(baskets.where(F.col("ctx").isin(short)), found)
        long = baskets.where(~F.col("ctx").isin(short))
        if long.isEmpty():
            break
        level, kind = common.written(_split(long, found)), "int"
        mixed = found.grouped(_stats(level, found.fewest), lambda g: found.tokens[g])
    found.rules.sort(key=lambda r: (-r[0], -r[1], len(r[2]), r[2], r[3]))
    rules = decisive([(groups, label) for _, _, groups, label in found.rules])
    places = {r: k for k, r in reversed([*enumerate((groups, label) for _, _, groups, label in found.rules)])}
    keys = [found.rules[places[r]] for r in rules]
    rank = [0]
    for before, now in zip(keys, keys[1:], strict=False):
        rank.append(rank[-1] + ((before[0], before[1], len(before[2])) != (now[0], now[1], len(now[2]))))
    used = {g for groups, _ in rules for g in groups}
    tokens: dict[str, list[int]] = defaultdict(list)
    for g in used:
        for t in found.tokens[g]:
            tokens[t].append(g)
    return Mined(dict(tokens), rules, rank[: len(rules)], inverted(rules))


def decisive(rules: list[tuple[tuple[int, ...], str]]) -> list[tuple[tuple[int, ...], str]]:
    """Of rules, best first, those that can decide: a rule behind another of the same label on some of its groups never does."""
    out, seen = [], set()
    for groups, label in rules:
        if not any((part, label) in seen for n in range(1, len(groups) + 1) for part in combinations(sorted(groups), n)):
            out.append((groups, label))
            seen.add((tuple(sorted(groups)), label))
    return out


def inverted(rules: list[tuple[tuple[int, ...], str]]) -> dict[int, list[int]]:
    index: dict[int, list[int]] = defaultdict(list)
    for k, (groups, _) in enumerate(rules):
        for g in groups:
            index[g].append(k)
    return dict(index)


def judge(tokens: list[str], mined: Mined) -> str:
    """The label of the best rule of whose groups the URL has all, else DEFAULT."""
    first: dict[int, str] = {}  # the first of the URL's tokens in each group
    for t in tokens:
        for g in mined.groups.get(t, ()):
            first[g] = min(t, first.get(g, t))
    have: dict[int, int] = defaultdict(int)
    whole = []
    for g in first:
        for k in mined.index.get(g, ()):
            have[k] += 1
            if have[k] == len(mined.rules[k][0]):
                whole.append(k)
    if not whole:
        return DEFAULT
    best = min(mined.rank[k] for k in whole)
    text = lambda k: (" ".join(sorted(first[g] for g in mined.rules[k][0])), mined.rules[k][1])
    return mined.rules[min((k for k in whole if mined.rank[k] == best), key=text)][1]


def filtered(pages: DataFrame, rules: list[Rule], labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """pages with host, path, rule and verdict.

    labelled: (url, label) to learn from. A null url, or one without `://`, has an empty
    host and path and no tokens: no rule fits and the verdict is DEFAULT. Urls are taken
    whole, of any length. Equal rows are judged alike. Other columns of pages pass through,
    whatever their names; those named like the four new ones are replaced.
    """
    n = labelled.count()
    some = labelled.where(common.hashed_share(F.col("url"), "url rules", sample / n)) if n > sample else labelled
    found = mine(some.select(tokens_of(F.col("url")).alias("tokens"), "label"))
    sent = pages.sparkSession.sparkContext.broadcast(found)
    own = pages.drop("host", "path", "rule", "verdict")
    names = own.columns
    tokens, learned, fit = (common.free(own, c) for c in ("tokens", "learned", "fit"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [judge(t or [], sent.value) for t in batch.column(tokens).to_pylist()]
            yield batch.set_column(batch.schema.names.index(learned), learned, pa.array(verdicts, pa.string()))

    own = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), tokens: tokens_of(F.col("url")), learned: F.lit(None).cast("string")})
    own = own.withColumn(fit, explicit(F.col("host"), F.col("path"), rules))
    own = own.mapInArrow(judged, own.schema)
    return own.select(*names, "host", "path", F.col(fit)["rule"].alias("rule"), F.coalesce(F.col(fit)["verdict"], F.col(learned)).alias("verdict"))
