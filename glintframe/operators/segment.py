"""Splitting runs of letters into words by a unigram table, kept as a trie in flat arrays."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Cost of a letter that is in no word.
UNKNOWN = 20.0


@dataclass(frozen=True)
class Trie:
    """Nodes by depth and then by their text, the root first. Node i's children are first[i] to first[i + 1], in order of their letters."""

    first: np.ndarray  # int32, one more than nodes
    letter: np.ndarray  # code points, in the smallest type that holds them
    rank: np.ndarray  # int32: the rank from 1 of the word that ends here, 0 if none does
    scale: float

    def nbytes(self) -> int:
        return self.first.nbytes + self.letter.nbytes + self.rank.nbytes


def trie(words: list[str]) -> Trie:
    """The words, the most frequent first; a word's cost comes from its rank, as Zipf's law has it. Repeated words keep their last rank."""
    rank = {w: k for k, w in enumerate(words) if w}
    ordered = sorted(rank)
    sizes = np.array([len(w) for w in ordered], np.int32)
    points = np.frombuffer("".join(ordered).encode("utf-32-le"), np.uint32)
    start = np.concatenate([[0], np.cumsum(sizes)])
    ranks = np.array([rank[w] + 1 for w in ordered], np.int32)
    letters, ends, counts = [np.zeros(1, np.uint32)], [np.zeros(1, np.int32)], []
    node = np.zeros(len(ordered), np.int64)  # of each word's prefix of the depth so far, within that depth
    alive = np.arange(len(ordered))
    nodes = 1
    for depth in range(int(sizes.max(initial=0))):
        alive = alive[sizes[alive] > depth]
        c = points[start[alive] + depth]
        parent = node[alive]
        fresh = np.ones(len(alive), bool)  # words are sorted, so those of one prefix are neighbours
        fresh[1:] = (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])
        node[alive] = np.cumsum(fresh) - 1
        counts.append(np.bincount(parent[fresh], minlength=nodes))
        nodes = int(fresh.sum())
        letters.append(c[fresh])
        end = np.zeros(nodes, np.int32)
        whole = alive[sizes[alive] == depth + 1]
        end[node[whole]] = ranks[whole]
        ends.append(end)
    counts.append(np.zeros(nodes, np.int64))
    first = np.concatenate([[1], 1 + np.cumsum(np.concatenate(counts))]).astype(np.int32)
    letter = np.concatenate(letters)
    return Trie(first, letter.astype(np.min_scalar_type(letter.max())), np.concatenate(ends), math.log(max(len(rank), 2)))


class Splitter:
    """Cheapest splits by a trie; children of nodes come from one search in a slice of letters."""

    def __init__(self, words: Trie) -> None:
        self.trie = words
        self.first, self.letter, self.rank = (memoryview(a) for a in (words.first, words.letter, words.rank))

    def ends(self, run: str, at: int):
        """(end, cost) of all words that start there."""
        node, first, letter, rank = 0, self.first, self.letter, self.rank
        for end in range(at, len(run)):
            c, lo, hi = ord(run[end]), first[node], first[node + 1]
            while lo < hi:
                mid = (lo + hi) >> 1
                if letter[mid] < c:
                    lo = mid + 1
                else:
                    hi = mid
            if lo >= first[node + 1] or letter[lo] != c:
                return
            node = lo
            if rank[node]:
                yield end + 1, math.log(rank[node] * self.trie.scale)

    def split(self, run: str) -> list[str]:
        """The cheapest words that make up run; letters of no word stay together. Of equal sums the one with the longer last word wins, a lone letter last."""
        best: list[tuple[float, int, bool] | None] = [(0.0, 0, True)] + [None] * len(run)
        for at in range(len(run)):
            so_far = best[at][0]
            for end, cost in self.ends(run, at):
                if best[end] is None or so_far + cost < best[end][0]:
                    best[end] = (so_far + cost, at, True)
            lone = so_far + UNKNOWN
            if best[at + 1] is None or (lone, at) < best[at + 1][:2]:
                best[at + 1] = (lone, at, False)
        out: list[tuple[str, bool]] = []
        end = len(run)
        while end:
            _, a, known = best[end]
            if out and not known and not out[-1][1]:
                out[-1] = (run[a:end] + out[-1][0], False)
            else:
                out.append((run[a:end], known))
            end = a
        return [w for w, _ in reversed(out)]
