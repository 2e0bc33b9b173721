"""image_prep: every byte of a document takes part in every prepared tensor."""

from __future__ import annotations

import numpy as np
import pytest

from glintframe.operators import pixels as P
from glintframe.plans import all_queries

MODELS = ("detector", "orientation", "encoder")


def test_late_bytes_move_all_means(spark, tmp_path):
    base = "a" * 96 * 400
    texts = [base, base[:3072] + "~" * (len(base) - 3072), base[: -96 * 9] + "~" * (96 * 9), "b", "", "a" * 97]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.model): r.mean for r in all_queries.QUERIES["image_prep"](spark, str(tmp_path)).collect()}
    assert len(got) == 18
    for model in MODELS:
        prep = P.PREPS[model]
        assert got[0, model] < got[2, model] < got[1, model]
        flat = np.mean([(ord("a") / 255 - m) / s for m, s in zip(prep.mean, prep.deviation, strict=True)])
        w, h = prep.size(32, 400)
        pad_w, pad_h = prep.padded(w, h)
        assert got[0, model] == pytest.approx(flat * w * h / (pad_w * pad_h), abs=1e-5)


def test_each_byte_counts():
    rng = np.random.default_rng(1)
    for rows in (1, 32, 33, 70):
        image = rng.integers(60, 190, (rows, 32, 3)).astype(np.uint8)
        for model in MODELS:
            before = P.tensor_of(image, P.PREPS[model])
            for at in {0, image.size // 2, image.size - 1}:
                other = image.copy()
                other.reshape(-1)[at] ^= 128
                assert abs(P.tensor_of(other, P.PREPS[model]) - before).max() > 1e-3
