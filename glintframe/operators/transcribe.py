"""Whole recordings to text, through the recognizers that streams use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.functions import audio
from glintframe.streaming.recognizer import RECOGNIZERS, Recognizer, listened

#: Seconds that a recording needs.
SHORTEST = 0.5
#: Samples that are listened to at once, about.
HELD = 1 << 18

#: Rate, samples and error.
Recording = tuple[int | None, np.ndarray | None, str | None]


def transcribed(recordings: DataFrame, recognizer: str) -> DataFrame:
    """(path, seconds, text, error) of mono recordings (path, rate, samples: -1 to 1, error).

    A recording's own error stays; one under SHORTEST seconds or of another rate than the
    recognizer's has an error and no text. Samples are decoded chunk by chunk, the last one filled
    with silence; a recording with nothing said has an empty text.
    """
    def rows(batch: pa.RecordBatch) -> Iterator[Recording]:
        samples = batch.column("samples")
        values, ends = samples.values.to_numpy(zero_copy_only=False), samples.offsets.to_numpy()
        for k, (rate, error) in enumerate(zip(batch.column("rate").to_pylist(), batch.column("error").to_pylist(), strict=True)):
            yield rate, values[ends[k] : ends[k + 1]] if samples[k].is_valid else None, error

    return _texts(recordings.select("path", "rate", F.col("samples").cast("array<double>").alias("samples"), "error"), recognizer, rows)


def transcribed_files(files: DataFrame, recognizer: str) -> DataFrame:
    """(path, seconds, text, error) of WAV files (path, content), of any number of channels; samples never move as rows."""
    return _texts(files.select("path", F.col("content").cast("binary").alias("content")), recognizer, lambda batch: (audio.wav_of(c) for c in batch.column("content").to_pylist()))


def _texts(recordings: DataFrame, recognizer: str, rows: Callable[[pa.RecordBatch], Iterator[Recording]]) -> DataFrame:
    """Recordings are listened to together, about HELD samples at a time."""
    factory, kind = RECOGNIZERS[recognizer], dict(recordings.dtypes)["path"]

    def checked(model: Recognizer, rate: int | None, samples: np.ndarray | None, error: str | None) -> tuple[float | None, str | None]:
        if error is not None or samples is None or not rate:
            return None, error or "no audio data"
        seconds = len(samples) / rate
        if len(samples) < rate // 2:
            return seconds, f"Audio too short ({seconds:.1f}s, need at least {SHORTEST:g}s)"
        return seconds, None if rate == round(model.chunk / model.seconds) else f"a rate of {rate} is not the recognizer's"

    def heard(model: Recognizer, held: list[np.ndarray]) -> Iterator[str]:
        """The text of each: as they are filled up to whole chunks, no chunk has parts of two."""
        counts = [-(-len(x) // model.chunk) for x in held]
        flat = np.zeros(sum(counts) * model.chunk)
        for x, at in zip(held, np.cumsum([0, *counts[:-1]]) * model.chunk, strict=True):
            flat[at : at + len(x)] = x
        chunks, step = listened(model, np.clip(np.rint(np.nan_to_num(flat) * 32768), -32768, 32767).astype(np.int16).tobytes())
        each = iter(chunks)
        for n in counts:
            memory, text = model.fresh(), ""
            for chunk in islice(each, n):
                memory, text, _ = step(memory, chunk)
            yield text.strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            seconds, errors, texts, held, total = [], [], [], [], 0
            for recording in rows(batch):
                length, error = checked(model, *recording)
                seconds.append(length)
                errors.append(error)
                if error is None:
                    held.append(recording[1])
                    total += len(recording[1])
                if total >= HELD:
                    texts += heard(model, held)
                    held, total = [], 0
            texts = iter(texts + list(heard(model, held)) if held else texts)
            text = [next(texts) if e is None else None for e in errors]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(seconds, pa.float64()), pa.array(text, pa.string()), pa.array(errors, pa.string())], ["path", "seconds", "text", "error"])

    return recordings.mapInArrow(run, f"path {kind}, seconds double, text string, error string")
