"""Streaming recognizers: plug-ins that decode PCM chunk by chunk, with a memory that fits in a stream's state."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np


class Recognizer(Protocol):
    """chunk: samples decoded at once; seconds: their duration."""

    chunk: int
    seconds: float

    def fresh(self) -> bytes:
        """The memory of a stream that has heard nothing."""

    def decode(self, memory: bytes, samples: bytes) -> tuple[bytes, str, bool]:
        """The memory after a chunk of 16-bit samples, the text so far, and whether the chunk held speech."""


class Listener(Recognizer, Protocol):
    """A recognizer whose work on sound needs no memory: it listens to many chunks at once and then goes on from chunk to chunk."""

    def listen(self, samples: bytes) -> list:
        """What each chunk of 16-bit samples holds."""

    def follow(self, memory: bytes, heard: object) -> tuple[bytes, str, bool]:
        """What decode gives for a chunk that holds this."""


def listened(model: Recognizer, samples: bytes) -> tuple[list, Callable[[bytes, object], tuple[bytes, str, bool]]]:
    """What whole chunks hold, and what decodes one; for a recognizer that is no Listener the chunks themselves."""
    if hasattr(model, "listen"):
        return model.listen(samples), model.follow
    size = 2 * model.chunk
    return [samples[at : at + size] for at in range(0, len(samples), size)], model.decode


RECOGNIZERS: dict[str, Callable[[], Recognizer]] = {}


class Tones:
    """Letters as tones: a chunk's strongest frequency is its letter, a chunk without energy is blank, repeats are one letter.

    A recognizer without weights, for signals made for it.
    """

    def __init__(self, letters: str, rate: int = 16_000, seconds: float = 0.04, lowest: int = 400, step: int = 200, loud: float = 0.02) -> None:
        self.letters, self.rate, self.seconds, self.lowest, self.step, self.loud = letters, rate, seconds, lowest, step, loud
        self.chunk = round(rate * seconds)

    def fresh(self) -> bytes:
        return b"0"

    def listen(self, samples: bytes) -> list[str]:
        x = np.frombuffer(samples, np.int16).reshape(-1, self.chunk) / 32768
        loud = np.sqrt((x * x).mean(1)) >= self.loud
        at = np.abs(np.fft.rfft(x[loud])).argmax(1) * self.rate / self.chunk
        letter = np.full(len(x), -1)
        letter[loud] = np.clip(np.rint((at - self.lowest) / self.step), 0, len(self.letters) - 1)
        return ["" if k < 0 else self.letters[k] for k in letter.tolist()]

    def follow(self, memory: bytes, heard: str) -> tuple[bytes, str, bool]:
        known = memory.decode()  # 0 after silence, 1 and the letter before, and then the text
        before, text = ("", known[1:]) if known[0] == "0" else (known[1], known[2:])
        if heard and heard != before:
            text += heard
        return (f"1{heard}{text}" if heard else "0" + text).encode(), text, bool(heard)

    def decode(self, memory: bytes, samples: bytes) -> tuple[bytes, str, bool]:
        return self.follow(memory, self.listen(samples)[0])


RECOGNIZERS["tones"] = lambda: Tones("abcdefghijklmnopqrstuvwxyz")
RECOGNIZERS["low tones"] = lambda: Tones("vspec", rate=2_000, lowest=200, step=100)
