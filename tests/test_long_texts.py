"""Alignment and word splitting at sizes that the plain ways don't take."""

from __future__ import annotations

import difflib
import itertools
import random
import time

import pytest

from glintframe.operators import align, segment


@pytest.mark.parametrize("letters", ["a", "ab", "abc ", "abcdefghijklmnop \n"])
def test_opcodes_equal_the_standard_ones(letters):
    rng = random.Random(len(letters))
    for _ in range(250):
        a = "".join(rng.choices(letters, k=rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 4)] = rng.choices(letters, k=rng.randrange(0, 4))
        b = "".join(b if rng.random() < 0.8 else rng.choices(letters, k=rng.randrange(0, 40)))
        assert align.Aligned(None, a, b, autojunk=False).get_opcodes() == difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_a_page_of_60_000_letters_ends_in_seconds():
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(2000)]
    a = " ".join(rng.choice(words) for _ in range(10_000))[:60_000]
    b = a.split(" ")
    for _ in range(400):
        b[rng.randrange(len(b))] = rng.choice(["", "x y", "zzz"])
    b = " ".join(b)
    began = time.monotonic()
    got = align.Aligned(None, a, b, autojunk=False).get_opcodes()
    assert time.monotonic() - began < 30
    assert "".join(b[c:d] for *_, c, d in got) == b and "".join(a[i:j] for _, i, j, *_ in got) == a
    assert all(a[i:j] == b[c:d] for kind, i, j, c, d in got if kind == "equal")
    assert sum(j - i for kind, i, j, *_ in got if kind == "equal") > 0.95 * len(a)


def plain_segment(run, words):
    """The split by a dictionary of costs, end by end."""
    cost = {w: segment.math.log((k + 1) * segment.math.log(max(len(words), 2))) for k, w in enumerate(words)}
    best = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        choices = [(best[a][0] + cost[run[a:end]], a) for a in range(end) if run[a:end] in cost]
        best.append(min([*choices, (best[end - 1][0] + segment.UNKNOWN, end - 1)]))
    out, end = [], len(run)
    while end:
        a = best[end][1]
        piece = run[a:end]
        if out and piece not in cost and out[-1] not in cost:
            out[-1] = piece + out[-1]
        else:
            out.append(piece)
        end = a
    return out[::-1]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh'", "aé中𝄞"])
def test_trie_splits_like_a_dictionary(letters):
    rng = random.Random(7)
    for _ in range(60):
        words = list(dict.fromkeys("".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 60))))
        known = segment.Splitter(segment.trie(words))
        for _ in range(10):
            run = "".join(rng.choices(letters + "z", k=rng.randrange(0, 25)))
            assert known.split(run) == plain_segment(run, words)


def test_two_million_words_fit_in_100_mb():
    rng = random.Random(1)
    parts = ["".join(p) for p in itertools.product("bcdfghklmnprst", "aeiou")]
    words = list({"".join(rng.choices(parts, k=4)) + rng.choice("aeionst") for _ in range(2_060_000)})
    assert len(words) > 2_000_000
    known = segment.trie(words[:2_000_000])
    assert known.nbytes() < 100_000_000
    run = words[5] + words[1_999_999]
    assert segment.Splitter(known).split(run) == [words[5], words[1_999_999]]
    assert dict(segment.Splitter(known).ends(words[77], 0))[len(words[77])] == pytest.approx(segment.math.log(78 * segment.math.log(2_000_000)))
