"""Speech sessions as a keyed stateful stream: partial texts, endpoints, resets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glintframe.streaming.recognizer import RECOGNIZERS, listened

OUTPUT = "stream_id long, seq long, type string, text string"
FRAMES = "stream_id long, ts timestamp, seq long, type string, text string"
HEARD = "stream_id long, chunk long, type string, text string"
#: Server frames given at once.
GIVEN = 1 << 14
#: Slots that streams are dealt to, a state each. A checkpoint holds for one number of slots.
SLOTS = 1024
#: Bytes of a block of waiting frames and of a run of blocks, about, and how they are ordered and packed.
BLOCK, RUN = 1 << 16, 1 << 22
ORDER = [("us", "ascending"), ("seq", "ascending")]
PACKED = pa.ipc.IpcWriteOptions(compression="lz4")


@dataclass(frozen=True)
class Rules:
    """When an utterance ends, in seconds: silence after it has a text, silence without one, and its longest duration."""

    gap: float
    longest: float
    idle: float = math.inf

    def silent(self, pause: float, said: bool) -> bool:
        return pause > (self.gap if said else self.idle)


def utterances(frames: DataFrame, rules: Rules) -> DataFrame:
    """(stream_id, utterance from 1, began, ended, frames, said, reason) of recorded frames (stream_id, ts, seq, said).

    The rules of the stateful stream over a table: silence (`silence`) ends an utterance before the
    next frame, its longest duration (`length`) at the first frame that reaches it; the next frame
    starts anew; the last one is `open`. Times are in seconds. Spark sorts each stream's frames and a
    task goes through them once, so a stream of any length takes the memory of one batch. Rows without
    stream_id or ts are left out; ties of ts go by seq.
    """
    rows = frames.where("stream_id is not null and ts is not null").select("stream_id", (F.unix_micros("ts") / 1e6).alias("at"), "seq", F.coalesce("said", F.lit(False)).alias("said"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream_id", "utterance", "began", "ended", "frames", "said", "reason"]
        out: list[tuple] = []
        stream, utterance, began, ended, count, spoke = None, 0, 0.0, 0.0, 0, False

        def given() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return made

        for batch in batches:
            for key, at, said in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "at", "said")), strict=True):
                if count and (key != stream or rules.silent(at - ended, spoke)):
                    out.append((stream, utterance, began, ended, count, spoke, "open" if key != stream else "silence"))
                    count = 0
                if key != stream:
                    stream, utterance, ended = key, 0, at
                if not count:
                    utterance, began, spoke = utterance + 1, at, False
                ended, count, spoke = at, count + 1, spoke or said
                if at - began >= rules.longest:
                    out.append((stream, utterance, began, ended, count, spoke, "length"))
                    count = 0
            if out:
                yield given()
        if count:
            out.append((stream, utterance, began, ended, count, spoke, "open"))
            yield given()

    ordered = rows.repartition("stream_id").sortWithinPartitions("stream_id", "at", "seq")
    return ordered.mapInArrow(cut, "stream_id long, utterance long, began double, ended double, frames long, said boolean, reason string")


def _joined(tables: list[pa.Table], *order: tuple[str, str]) -> pa.Table:
    return pa.concat_tables(tables).combine_chunks().sort_by([*order, *ORDER])


def _packed(frames: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, frames.schema, options=PACKED) as w:
        w.write_table(frames)
    return sink.getvalue().to_pybytes()


def _values(column: pa.ChunkedArray) -> list:
    """The column's values; lists as arrays that share its memory."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    flat, ends = one.values.to_numpy(zero_copy_only=False), one.offsets.to_pylist()
    return [flat[a:b] if known else None for a, b, known in zip(ends[:-1], ends[1:], one.is_valid().to_pylist(), strict=True)]


class InOrder(StatefulProcessor):
    """Frames of the streams of a slot, each stream's in order of (time, seq), whatever batches they come in.

    A key is a slot of many streams, as each key costs a dozen calls to the state store; where frames
    come without stream_id, it is the stream itself. Frames wait in a map state until the watermark
    has passed their second, as then no earlier one can come: `take` gets a stream's in order, and
    `quiet` learns how far time has come without another. An entry is a block of about BLOCK bytes of
    ordered frames under its first time. Blocks may overlap, so what comes is never sorted into all
    that waits; they are merged when their time has passed. What comes in small pieces is gathered in one
    block, the tail (run -1). A timer in event time wakes the slot for the next second that waits and
    for the next silence that ends an utterance. In memory are a few blocks, one more of each run of
    blocks that overlap, GIVEN rows and what the slot's open streams remember; what waits is what
    came within the lateness that the watermark allows.
    """

    schema: pa.Schema  # of frames: us, seq, type and what they carry
    names: list[str]  # of the rows given, without the stream
    remembered: pa.Schema  # what an open stream remembers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long, run long", "frames binary")
        self.slot = handle.getValueState("slot", "timer long, first long, tail long, run long, streams binary")
        self.frames = pa.schema([("stream_id", pa.int64()), *self.schema])
        self.open = pa.schema([("stream_id", pa.int64()), *self.remembered])
        self.opened()

    def opened(self) -> None: ...

    def resumed(self, memory: tuple | None) -> None:
        """The stream that the next calls are about; None: it begins."""

    def take(self, frame: tuple, out: list[tuple]) -> None: ...

    def quiet(self, now: float, out: list[tuple]) -> float | None:
        """now: time up to which all frames have come, in seconds. Returns when to look again, None if the stream is over."""

    def kept(self) -> tuple:
        """What the stream remembers."""

    def _load(self) -> None:
        """timer, first: the timer set and the first time that waits, if any; tail: the tail's; run: of the next block; streams: what open streams remember."""
        found = self.slot.get()
        self.timer, self.first, self.tail, self.run, streams = found if found is not None else (None, None, None, 0, None)
        self.streams: dict[int, tuple] = {}
        if streams is not None:
            columns = pa.ipc.open_stream(bytes(streams)).read_all().columns
            self.streams = {stream: memory for stream, *memory in zip(*(c.to_pylist() for c in columns), strict=True)}

    def _save(self, timer: int | None) -> None:
        if timer != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if timer is not None:
                self.handle.registerTimer(timer)
        if timer is not None:
            columns = zip(*((stream, *memory) for stream, memory in self.streams.items()), strict=True)
            streams = _packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.open, strict=True)], schema=self.open)) if self.streams else None
            self.slot.update((timer, self.first, self.tail, self.run, streams))
        elif self.slot.exists():
            self.slot.clear()

    def _keep(self, frames: pa.Table) -> None:
        """Ordered frames as blocks; a few frames go to the tail."""
        if not len(frames):
            return
        if frames.nbytes < BLOCK // 2 and self.tail is not None:
            frames, self.tail = _joined([self._taken_out((self.tail, -1)), frames]), None
        us = frames["us"]
        first = us[0].as_py()
        self.first = first if self.first is None else min(self.first, first)
        if frames.nbytes < BLOCK // 2:
            self.tail = first
            self.waiting.updateValue((first, -1), (_packed(frames),))
            return
        n = min(-(-frames.nbytes // BLOCK), len(us))
        cuts = [len(us) * k // n for k in range(n + 1)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            self.waiting.updateValue((us[low].as_py(), self.run), (_packed(frames.slice(low, high - low)),))
            self.run += 1

    def _taken_out(self, key: tuple[int, int]) -> pa.Table:
        frames = pa.ipc.open_stream(bytes(self.waiting.getValue(key)[0])).read_all()
        self.waiting.removeKey(key)
        return frames

    def _wait(self, key: tuple, rows: Iterator[pd.DataFrame]) -> None:
        new: list[pa.Table] = []
        for pdf in rows:
            if "stream_id" not in pdf:
                pdf = pdf.assign(stream_id=key[0])
            new.append(pa.Table.from_pandas(pdf[self.frames.names], self.frames, preserve_index=False))
            if sum(t.nbytes for t in new) >= RUN:
                self._keep(_joined(new))
                new = []
        if new:
            self._keep(_joined(new))

    def _passed(self, until: int) -> Iterator[pa.Table]:
        """Frames before a time, each piece's after those of the pieces before, by stream and then in order. What is left of their blocks waits on."""
        if self.first is None or self.first >= until:
            return
        keys = sorted(tuple(k) for k in self.waiting.keys())
        n = sum(us < until for us, _ in keys)
        self.first = keys[n][0] if n < len(keys) else None
        held: list[pa.Table] = []
        size = left = 0
        for k, key in enumerate(keys[:n]):
            if key[1] < 0:
                self.tail = None
            held.append(self._taken_out(key))
            size += held[-1].nbytes
            if k + 1 < n and size < 2 * left + 16 * BLOCK:
                continue
            upto = keys[k + 1][0] if k + 1 < n else until  # no block that is not held begins earlier
            cuts = [int(np.searchsorted(t["us"].to_numpy(), upto)) for t in held]
            done = [t.slice(0, c) for t, c in zip(held, cuts, strict=True) if c]
            held = [t.slice(c) for t, c in zip(held, cuts, strict=True) if c < len(t)]
            size = left = sum(t.nbytes for t in held)
            if done:
                yield _joined(done, ("stream_id", "ascending"))
        if held:
            self._keep(_joined(held))

    def _advanced(self, key: tuple, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs()
        out: list[tuple] = []
        whose: list[int] = []  # the stream of each row

        def given(stream: int, least: int) -> Iterator[pd.DataFrame]:
            whose.extend([stream] * (len(out) - len(whose)))
            if len(out) >= least:
                yield pd.DataFrame([(s, *r) for s, r in zip(whose, out, strict=True)], columns=["stream_id", *self.names])
                out.clear()
                whose.clear()

        for frames in self._passed(now // 1000 * 1_000_000):
            streams = frames["stream_id"].to_numpy()
            columns = [_values(frames[name]) for name in self.schema.names]
            cuts = [0, *(np.flatnonzero(np.diff(streams)) + 1).tolist(), len(streams)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                stream = int(streams[low])
                self.resumed(self.streams.get(stream))
                for frame in zip(*(c[low:high] for c in columns), strict=True):
                    self.take(frame, out)
                    if len(out) >= GIVEN:
                        yield from given(stream, GIVEN)
                self.streams[stream] = self.kept()
                yield from given(stream, GIVEN)
        next_ = [] if self.first is None else [(self.first // 1_000_000 + 1) * 1000]
        for stream, memory in list(self.streams.items()):
            self.resumed(memory)
            again = self.quiet(now / 1000, out)
            yield from given(stream, GIVEN)
            if again is None:
                del self.streams[stream]
            else:
                self.streams[stream] = self.kept()
                next_.append(int(again * 1000) + 1)
        self._save(max(min(next_), now + 1) if next_ else None)
        yield from given(0, 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        self._wait(key, rows)
        yield from self._advanced(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        yield from self._advanced(key, timerValues)

    def close(self) -> None:
        pass


class Session(InOrder):
    """A stream of recognized frames: audio, reset, close.

    A change of the recognized text gives a `partial`. Silence of `gap` seconds after the last
    frame of an utterance with a text (`idle` without one; `expires` where that is no end) or an
    utterance of `longest` seconds gives a `final` (if there is a text) and an `endpoint`, both with
    the seq of the utterance's last frame. A reset forgets the utterance; a close ends the stream:
    its open partial is lost and its state goes.
    """

    schema = pa.schema([("us", pa.int64()), ("seq", pa.int64()), ("type", pa.string()), ("text", pa.string())])
    names = ["seq", "type", "text"]
    remembered = pa.schema([("text", pa.string()), ("began", pa.float64()), ("last", pa.float64()), ("seq", pa.int64())])

    def __init__(self, gap: float, longest: float, idle: float = math.inf, expires: float = 3600.0) -> None:
        self.rules = Rules(gap, longest, idle if math.isfinite(idle) else expires)

    def resumed(self, memory: tuple | None) -> None:
        self.text, self.began, self.last, self.seq = memory or ("", -1.0, -1.0, -1)

    def kept(self) -> tuple:
        return self.text, self.began, self.last, self.seq

    def _end(self, out: list[tuple]) -> None:
        if self.text:
            out.append((self.seq, "final", self.text))
        out.append((self.seq, "endpoint", None))
        self.text, self.began = "", -1.0

    def take(self, frame: tuple, out: list[tuple]) -> None:
        us, seq, kind, said = frame
        at = us / 1e6
        if self.began >= 0 and self.rules.silent(at - self.last, bool(self.text)):
            self._end(out)
        self.last, self.seq = at, seq
        if kind in ("reset", "close"):
            self.text, self.began = "", -1.0
            return
        if self.began < 0:
            self.began = at
        if said and said != self.text:
            self.text = said
            out.append((seq, "partial", said))
        if at - self.began >= self.rules.longest:
            self._end(out)

    def quiet(self, now: float, out: list[tuple]) -> float | None:
        if self.began >= 0 and self.rules.silent(now - self.last, bool(self.text)):
            self._end(out)
        return None if self.began < 0 else self.last + (self.rules.gap if self.text else self.rules.idle)


class Hearing(InOrder):
    """A stream of PCM frames through a recognizer: audio, reset, close.

    Samples are decoded in the recognizer's chunks wherever frames end, so partials, finals and
    endpoints don't hang on how the stream was cut; each carries the number of its chunk since the
    stream began. Silence and length count heard chunks. Between batches the state is less than a chunk of
    samples and what the recognizer remembers. A stream without a frame for `expires` seconds is over.
    """

    schema = pa.schema([("us", pa.int64()), ("seq", pa.int64()), ("type", pa.string()), ("pcm", pa.list_(pa.int16()))])
    names = ["chunk", "type", "text"]
    remembered = pa.schema([("rest", pa.binary()), ("memory", pa.binary()), ("text", pa.string()), *((name, pa.int64()) for name in ("heard", "silent", "length")), ("last", pa.float64())])

    def __init__(self, recognizer: str, rules: Rules, expires: float = 3600.0) -> None:
        self.factory, self.rules, self.expires = RECOGNIZERS[recognizer], rules, expires
        self.model = None

    def opened(self) -> None:
        self.model = self.factory()

    def resumed(self, memory: tuple | None) -> None:
        rest, self.memory, self.text, self.heard, self.silent, self.length, self.last = memory or (b"", self.model.fresh(), "", 0, 0, 0, -1.0)
        self.rest = [rest]

    def kept(self) -> tuple:
        return b"".join(self.rest), self.memory, self.text, self.heard, self.silent, self.length, self.last

    def _anew(self) -> None:
        self.memory, self.text, self.silent, self.length = self.model.fresh(), "", 0, 0

    def take(self, frame: tuple, out: list[tuple]) -> None:
        us, _, kind, pcm = frame
        self.last = us / 1e6
        if kind in ("reset", "close"):
            self.rest = []
            self._anew()
            if kind == "close":
                self.heard, self.last = 0, -1.0
            return
        self.rest.append(b"" if pcm is None else pcm.astype(np.int16).tobytes())
        size = 2 * self.model.chunk
        if sum(map(len, self.rest)) < size:
            return
        whole = b"".join(self.rest)
        chunks, follow = listened(self.model, whole[: len(whole) - len(whole) % size])
        seconds, gap, idle, longest = self.model.seconds, self.rules.gap - 1e-9, self.rules.idle - 1e-9, self.rules.longest - 1e-9
        for chunk in chunks:
            self.memory, text, speech = follow(self.memory, chunk)
            self.silent, self.length = 0 if speech else self.silent + 1, self.length + 1
            if text and text != self.text:
                self.text = text
                out.append((self.heard, "partial", text))
            if self.silent * seconds >= (gap if self.text else idle) or self.length * seconds >= longest:
                if self.text:
                    out.append((self.heard, "final", self.text))
                out.append((self.heard, "endpoint", None))
                self._anew()
            self.heard += 1
        self.rest = [whole[len(whole) - len(whole) % size :]]

    def quiet(self, now: float, out: list[tuple]) -> float | None:
        return None if self.last < 0 or now - self.last > self.expires else self.last + self.expires


def slotted(frames: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Frames with the slot of their stream."""
    return frames.withColumn("slot", F.pmod(F.xxhash64(F.col("stream_id").cast("long")), F.lit(slots)))


def _by_slot(frames: DataFrame, what: str, processor: InOrder, output: str, late: float) -> DataFrame:
    frames = frames if "slot" in frames.columns else slotted(frames)
    known = frames.where("stream_id is not null and ts is not null").withWatermark("ts", f"{late:g} seconds")
    rows = known.select("slot", "stream_id", "ts", F.unix_micros("ts").alias("us"), "seq", "type", what)
    return rows.groupBy("slot").transformWithStateInPandas(processor, output, "Append", "EventTime")


def sessions(frames: DataFrame, gap: float, longest: float, idle: float = math.inf, expires: float = 3600.0, late: float = 60.0) -> DataFrame:
    """Server frames of a stream of client frames (stream_id, ts, seq, type, text), which come up to `late` seconds late, in any order.

    Needs the session's state store provider to be RocksDB. Rows without stream_id or ts are left out.
    Frames may come with a slot, the same for all of a stream (`slotted`).
    """
    return _by_slot(frames, "text", Session(gap, longest, idle, expires), OUTPUT, late)


def heard(frames: DataFrame, recognizer: str, rules: Rules = Rules(0.8, 20.0, 2.4), expires: float = 3600.0, late: float = 60.0) -> DataFrame:
    """Server frames of a stream of PCM frames (stream_id, ts, seq, type, pcm: 16-bit samples), which come up to `late` seconds late, in any order.

    Needs the session's state store provider to be RocksDB. Rows without stream_id or ts are left
    out; a null pcm is an empty one. Frames may come with a slot, the same for all of a stream (`slotted`).
    """
    return _by_slot(frames, "pcm", Hearing(recognizer, rules, expires), HEARD, late)


def run_now(result: DataFrame, home: str) -> None:
    """Runs a streaming result over all that is there, into Parquet under home/out."""
    result.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
