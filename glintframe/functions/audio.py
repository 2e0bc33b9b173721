"""Audio: PCM samples and WAV files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_pcm16(samples: Column) -> Column:
    """Signed 16-bit samples as numbers of -1 to 1."""
    return F.transform(samples, lambda s: s / F.lit(32768.0))


def mono(samples: Column, channels: int) -> Column:
    """Means of frames of interleaved channels; a last short frame divides by the channels all the same."""
    frames = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(samples) / channels).cast("int") - 1, F.lit(0)))
    one = lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels
    return F.when(F.size(samples) == 0, samples).otherwise(F.transform(frames, one))


def wav_array(content: bytes) -> tuple[np.ndarray, int]:
    """(mono samples, rate) of a RIFF file of 8 to 32-bit integers or 32-bit floats."""
    kind = channels = rate = bits = 0
    at = 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            width = bits // 8
            body = body[: len(body) // width * width]
            if kind == 3:
                x = np.frombuffer(body, "<f4").astype(float)
            elif width == 1:
                x = (np.frombuffer(body, np.uint8).astype(float) - 128) / 128
            elif width == 2:
                x = np.frombuffer(body, "<i2") / 32768.0
            else:
                raw = np.frombuffer(body, np.uint8).reshape(-1, width)
                wide = np.zeros((len(raw), 4), np.uint8)
                wide[:, 4 - width :] = raw
                x = wide.view("<i4").ravel() / float(1 << 31)
            if channels == 1:
                return x, rate
            x = np.concatenate([x, np.zeros(-len(x) % channels)])
            return x.reshape(-1, channels).sum(1) / channels, rate
        at += 8 + size + size % 2
    raise ValueError("no audio data")


def read_wav(content: bytes) -> tuple[list[float], int]:
    """wav_array with the samples as a list."""
    samples, rate = wav_array(content)
    return samples.tolist(), rate


def wav_of(content: bytes | None) -> tuple[int | None, np.ndarray | None, str | None]:
    """(rate, samples, error) of a file."""
    try:
        samples, rate = wav_array(content)
        return rate, samples, None
    except (ValueError, TypeError, ZeroDivisionError, struct.error) as e:
        return None, None, str(e) or type(e).__name__


def wav_samples(files: DataFrame) -> DataFrame:
    """(path, rate, samples, error) of (path, content). A null or malformed file has an error and neither rate nor samples."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, samples, error = zip(*map(wav_of, batch.column("content").to_pylist()), strict=True) if len(batch) else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rate, pa.int32()), pa.array(samples, pa.list_(pa.float64())), pa.array(error, pa.string())], ["path", "rate", "samples", "error"])

    kind = dict(files.dtypes)["path"]
    return files.select("path", "content").mapInArrow(read, f"path {kind}, rate int, samples array<double>, error string")
