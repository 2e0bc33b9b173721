"""Merging detected blocks with a model's plain text by character alignment."""

from __future__ import annotations

import difflib
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Aligned(difflib.SequenceMatcher):
    """The standard matcher with its longest common block found in linear time, by a suffix automaton of the second text's part.

    Of blocks of one length the first in the first text wins, then the first in the second: the standard one's own rule.
    """

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        a, b = self.a, self.b
        ahi, bhi = len(a) if ahi is None else ahi, len(b) if bhi is None else bhi
        if alo >= ahi or blo >= bhi:
            return difflib.Match(alo, blo, 0)
        if a[alo:ahi] == b[blo:bhi]:
            return difflib.Match(alo, blo, ahi - alo)
        # states of the automaton: transitions, longest text, link, end of the first occurrence
        steps, longest, link, first = [{}], [0], [-1], [-1]
        last = 0
        for j in range(blo, bhi):
            c, new = b[j], len(steps)
            steps.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            first.append(j)
            p, last = last, new
            while p >= 0 and c not in steps[p]:
                steps[p][c] = new
                p = link[p]
            if p < 0:
                continue
            q = steps[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
                continue
            split = len(steps)
            steps.append(steps[q].copy())
            longest.append(longest[p] + 1)
            link.append(link[q])
            first.append(first[q])
            while p >= 0 and steps[p].get(c) == q:
                steps[p][c] = split
                p = link[p]
            link[q] = link[new] = split
        state = size = 0
        best = (alo, blo, 0)
        for i in range(alo, ahi):
            c = a[i]
            while state and c not in steps[state]:
                state = link[state]
                size = longest[state]
            if c in steps[state]:
                state, size = steps[state][c], size + 1
            if size > best[2]:
                best = (i - size + 1, first[state] - size + 1, size)
        return difflib.Match(*best)


def shares(length: int, weights: list[int]) -> list[int]:
    """length split by weights, halves rounded to even, the rest to the last."""
    total, out = sum(weights), []
    for w in weights[:-1]:
        out.append(round(length * w / total))
    return [*out, max(0, length - sum(out))]


def merge(blocks: list[str], plain: str) -> list[str]:
    """The text of every block after alignment; a block that gets none keeps its own. A null block is an empty one."""
    blocks = [b or "" for b in blocks]
    own = [b.strip() for b in blocks]
    plain = plain.strip()
    if not plain or not blocks:
        return list(blocks)
    starts, at = [], 0
    for b in own:
        starts.append(at)
        at += len(b) + 1
    ends = [s + len(b) for s, b in zip(starts, own, strict=True)]
    got: list[list[str]] = [[] for _ in own]

    def overlaps(a: int, b: int) -> list[tuple[int, int, int]]:
        cut = [(k, max(a, s), min(b, e)) for k, (s, e) in enumerate(zip(starts, ends, strict=True))]
        return [x for x in cut if x[1] < x[2]]

    for kind, a, b, c, d in Aligned(None, "\n".join(own), plain, autojunk=False).get_opcodes():
        piece = plain[c:d]
        met = overlaps(a, b)
        if kind == "equal":
            for k, s, e in met:
                got[k].append(piece[s - a : e - a])
        elif kind == "replace" and met:
            at = 0
            for (k, _, _), n in zip(met, shares(len(piece), [e - s for _, s, e in met]), strict=True):
                got[k].append(piece[at : at + n])
                at += n
            got[met[-1][0]].append(piece[at:])
        elif kind == "insert":
            _insert(got, starts, ends, a, piece, c > 0 and plain[c - 1] == "\n")
    return ["".join(g).strip() or o for g, o in zip(got, own, strict=True)]


def _insert(got: list[list[str]], starts: list[int], ends: list[int], at: int, piece: str, new_line: bool) -> None:
    """Text that no block has: inside a block it is that block's; between blocks the line it stands on decides."""
    inside = bisect_right(starts, at) - 1
    within = inside >= 0 and starts[inside] <= at < ends[inside]
    if within and at > starts[inside]:
        got[inside].append(piece)
        return
    if within:
        # of blocks that start here (empty ones come first) the one that holds the place
        before, after = (inside - 1 if inside else None), inside
    else:
        ended = bisect_right(ends, at) - 1
        follows = bisect_left(starts, at)
        before, after = (ended if ended >= 0 else None), (follows if follows < len(starts) else None)
    head, line_feed, _ = piece.partition("\n")
    if line_feed:
        if head and not new_line and before is not None:
            got[before].append(head)
    elif new_line and after is not None or before is None:
        if after is not None:
            got[after].append(piece)
    else:
        got[before].append(piece)


def hybrid(blocks: DataFrame, plain: DataFrame) -> DataFrame:
    """(image_id, block_no, text) from blocks (image_id, block_no, text) and plain (image_id, text): one row of arrays an image."""
    listed = blocks.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("blocks"))
    both = listed.join(plain.select("image_id", F.col("text").alias("plain")), "image_id", "left")

    @F.pandas_udf("array<string>")
    def merged(all_blocks: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([merge([b["text"] for b in bs], t or "") for bs, t in zip(all_blocks, texts, strict=True)])

    out = both.withColumn("merged", merged("blocks", "plain"))
    zipped = F.arrays_zip(F.col("blocks.block_no").alias("block_no"), F.col("merged").alias("text"))
    return out.select("image_id", F.explode(zipped).alias("r")).select("image_id", "r.block_no", "r.text")
