"""Exact copies of long vectors among a query's neighbours."""

from __future__ import annotations

import numpy as np

from glintframe.llm import ann


def test_copies_of_long_vectors_are_found():
    rng = np.random.default_rng(0)
    rotation, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    index = ann.Index(np.zeros((1, 64)), rotation, 1)
    for norm in (1, 1000, 100_000):
        q = rng.standard_normal((100, 64))
        q *= norm / np.linalg.norm(q, axis=1, keepdims=True)
        for k in range(len(q)):
            i, _, d = ann.scan(index, q[k : k + 1], np.array([-1]), np.repeat(q[k : k + 1], 200, axis=0), np.arange(200), 10)
            assert len(i) == 10 and not d.any()
