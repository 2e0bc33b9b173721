"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of DIMENSIONS entries, drawn from its
code point. An n-gram's vector binds (multiplies) its letters' vectors, each permuted
(rotated) once for every place that it stands before the last. A text's vector bundles
(adds) the vectors of all its n-grams, and a language's prototype those of its sample
texts. A text gets the language whose prototype has the largest cosine with it.

Anything but letters counts as one word boundary; letters are lower-cased.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common

DIMENSIONS, N = 512, 3
#: Expected sample texts for each language.
SAMPLE = 1000
#: Languages whose sums a task holds at once.
HELD = 4096
#: Characters taken at once, a longer text is bundled in parts; n-grams whose vectors are made at once.
PART, GRAMS = 1 << 16, 2048
#: Letters whose vectors a worker keeps ready.
READY = 1 << 14
_MASK = (1 << 21) - 1


class Letters:
    """Vectors of code points, drawn as they come, in every permutation that an n-gram needs; at most READY are kept."""

    def __init__(self, dimensions: int, n: int = N) -> None:
        self.dimensions, self.n = dimensions, n
        self._empty()

    def _empty(self) -> None:
        self.points = np.empty(0, np.int64)  # in order; row i of each turned table is that of points[i]
        self.turned = [np.empty((0, self.dimensions), np.int8) for _ in range(self.n)]

    def letter(self, point: int) -> np.ndarray:
        return np.random.default_rng(point).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1

    def _learn(self, points: np.ndarray) -> None:
        new = np.setdiff1d(points, self.points)
        if not len(new):
            return
        if len(self.points) + len(new) > READY:
            self._empty()
            new = points
        drawn = np.stack([self.letter(p) for p in new.tolist()])
        order = np.argsort(np.concatenate([self.points, new]), kind="stable")
        self.points = np.concatenate([self.points, new])[order]
        self.turned = [np.concatenate([old, np.roll(drawn, place, axis=1)])[order] for place, old in enumerate(self.turned)]

    def grams(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of n-grams, each given as 21-bit code points in one integer, the last letter lowest."""
        letters = [(keys >> (21 * place)) & _MASK for place in range(self.n)]
        self._learn(np.unique(np.concatenate(letters)))
        out = self.turned[0][np.searchsorted(self.points, letters[0])]
        for place in range(1, self.n):
            out *= self.turned[place][np.searchsorted(self.points, letters[place])]
        return out


@functools.cache
def letters_of(dimensions: int) -> Letters:
    """One table a worker process."""
    return Letters(dimensions)


def points_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other characters than letters as one 0, at both ends too."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = np.zeros(len(points), bool)
    plain = points < 128
    letter[plain] = (points[plain] >= 97) & (points[plain] <= 122)
    if not plain.all():
        other, inverse = np.unique(points[~plain], return_inverse=True)
        letter[~plain] = np.array([chr(p).isalpha() for p in other.tolist()], bool)[inverse]
    if not letter.any():
        return np.empty(0, np.int64)
    points = np.where(letter, points, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep]
    return np.concatenate([np.zeros(1, np.int64), points, np.zeros(1, np.int64)]) if points[-1] else np.concatenate([np.zeros(1, np.int64), points])


def bundle(text: str | None, letters: Letters) -> np.ndarray | None:
    """The text's vector, of whole numbers; None without a letter."""
    points = points_of(text) if text else ()
    if not len(points):
        return None
    n, total = letters.n, np.zeros(letters.dimensions)
    for at in range(0, max(1, len(points) - n + 1), PART):
        part = points[at : at + PART + n - 1]
        keys = np.zeros(max(0, len(part) - n + 1), np.int64)
        for place in range(n):
            keys |= part[n - 1 - place : len(part) - place] << (21 * place)
        grams, counts = np.unique(keys, return_counts=True)
        for k in range(0, len(grams), GRAMS):
            total += counts[k : k + GRAMS].astype(np.float32) @ letters.grams(grams[k : k + GRAMS]).astype(np.float32)
    return total


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Prototypes from (doc_id, text, lang): about `sample` texts of each language.

    The sample is fixed by a hash of doc_id (of the text, where that is null); null
    languages and texts are left out; repeated rows count each time.
    Only the sums reach the driver: 8 * dimensions bytes a language, which each worker holds, too.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shares = known.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    chosen = known.join(F.broadcast(shares), "lang").where(common.hashed_share(F.coalesce(F.col("doc_id"), F.xxhash64("text")), "langid", share)).select("lang", "text")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = letters_of(dimensions), {}

        def held() -> Iterator[pa.RecordBatch]:
            while total:
                lang, v = total.popitem()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(np.rint(v).astype(np.int64))], ["lang", "at", "value"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if (v := bundle(text, letters)) is not None:
                    total[lang] = total.get(lang, 0) + v
                    if len(total) > HELD:
                        yield from held()
        yield from held()

    # written first: the whole table is scanned by as many tasks as it has, the sample's sums come from a few
    parts = common.written(chosen).mapInArrow(sums, "lang string, at int, value long")
    whole = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("v"))
    rows = whole.select("lang", "v.value").orderBy("lang").toArrow()
    values = rows.column("value").combine_chunks()
    return rows.column("lang").to_pylist(), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """docs with `lang_pred` and `score`: the nearest prototype (ties: the first by name) and its cosine, not below 0.

    Text null or without a letter: `und` with score 0; so is every text where nothing was learned.
    Equal texts get equal answers. Other columns pass through; those named like the new two are replaced.
    """
    rest = docs.drop("lang_pred", "score")
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True) if len(names) else np.ones((0, 1))
    unit = prototypes / np.where(norm > 0, norm, 1)
    own = rest.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letters_of(unit.shape[1])
        for batch in batches:
            lang, score = [], []
            for text in common.text_column(batch, "text"):
                v = bundle(text.as_py(), letters) if names else None
                size = 0.0 if v is None else float(np.linalg.norm(v))
                if not size:
                    lang.append("und")
                    score.append(0.0)
                    continue
                near = unit @ v / size
                best = int(np.argmax(near))
                lang.append(names[best])
                score.append(float(min(1.0, max(0.0, near[best]))))
            fields = [n for n in batch.schema.names if n in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in fields), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*fields, "lang_pred", "score"])

    return rest.mapInArrow(apply, common.schema_with(rest, lang_pred=T.StringType(), score=T.DoubleType()))
