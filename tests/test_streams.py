"""Speech streams: order across batches, recognizers on PCM however it is cut, bounded state."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
import uuid

import numpy as np
import pandas as pd
import pytest

from glintframe.operators.transcribe import transcribed
from glintframe.streaming import stt
from glintframe.streaming.recognizer import RECOGNIZERS, Tones

START = dt.datetime(2024, 1, 1)


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    def exists(self):
        return bool(self)

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def keys(self):
        return list(super().keys())


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers, self.map, self.value = [], Map(), Value()

    def getMapState(self, *_):
        return self.map

    def getValueState(self, *_):
        return self.value

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def played(processor, batches, late):
    """Rows and the handle after batches of frames (us, seq, type, carried); the watermark follows the latest frame and moves on at the end."""
    handle = Handle()
    processor.init(handle)
    rows, latest, waiting = [], 0, 0
    name = processor.schema.names[3]
    for batch in [*batches, None]:
        now = max(0, latest - late * 1_000_000) // 1000 if batch is not None else latest // 1000 + 10**8
        while handle.timers and min(handle.timers) <= now:
            rows += [tuple(r)[1:] for pdf in processor.handleExpiredTimer((1,), Time(now), None) for r in pdf.itertuples(index=False)]
        if batch is not None:
            pdf = pd.DataFrame(batch, columns=["us", "seq", "type", name])
            rows += [tuple(r)[1:] for out in processor.handleInputRows((1,), iter([pdf]), Time(now)) for r in out.itertuples(index=False)]
            latest = max([latest, *(f[0] for f in batch)])
        waiting = max(waiting, len(handle.map))
    return rows, handle, waiting


def speech(n, seed):
    rng, us, out = random.Random(seed), 0, []
    for k in range(n):
        us += rng.choice([200_000, 900_000, 1_500_000, 30_000_000])
        out.append((us, k, rng.choice(["audio"] * 8 + ["reset", "close"]), rng.choice(["a", "b", "ab", None])))
    return out


def plain(frames, gap, longest, idle):
    """The rules in one pass over all frames."""
    out, text, began, last, seq = [], "", None, None, None
    for us, now, kind, said in [*frames, (10**15, None, None, None)]:
        at = us / 1e6
        if began is not None and at - last > (gap if text else idle):
            out += [(seq, "final", text)] * bool(text) + [(seq, "endpoint", None)]
            text, began = "", None
        if kind in ("reset", "close"):
            text, began = "", None
        elif kind:
            began = at if began is None else began
            if said and said != text:
                text = said
                out.append((now, "partial", said))
            if at - began >= longest:
                out += [(now, "final", text)] * bool(text) + [(now, "endpoint", None)]
                text, began = "", None
        last, seq = at, now
    return out


@pytest.mark.parametrize("size", [1, 7, 50, 2000])
def test_order_is_kept_across_batches(size):
    """Frames up to 40 seconds out of order, in batches of any size, give the rows of the sorted stream; what waits is what came within the lateness."""
    frames = speech(600, 4)
    rng = random.Random(size)
    mixed = sorted(frames, key=lambda f: f[0] + rng.uniform(0, 40e6))
    batches = [mixed[k : k + size] for k in range(0, len(mixed), size)]
    rows, handle, waiting = played(stt.Session(20, 100, 25), batches, 40)
    assert rows == plain(frames, 20, 100, 25)
    assert not handle.map and not handle.timers and not handle.value.exists()
    assert size > 50 or waiting < 60 + size


def fed(session, rows):
    return played(session, [[(int(s * 1e6), *r) for s, *r in rows]], 1)[:2]


def test_session_rules_by_hand():
    rows = [(0, 0, "audio", "a"), (1, 1, "audio", "a"), (3, 2, "audio", "b"), (6, 3, "audio", "c"), (7, 4, "reset", None), (8, 5, "audio", "d"), (9, 6, "close", None)]
    out, handle = fed(stt.Session(2.0, 5.0), rows)
    assert out == [(0, "partial", "a"), (2, "partial", "b"), (2, "final", "b"), (2, "endpoint", None), (3, "partial", "c"), (5, "partial", "d")]
    assert not handle.value.exists() and not handle.timers and not handle.map  # closed: nothing is kept


def test_silence_without_a_text_takes_longer():
    rows = [(0, 0, "audio", None), (3, 1, "audio", None), (9, 2, "audio", "a"), (12, 3, "audio", None), (13, 4, "close", None)]
    assert fed(stt.Session(2.0, 50.0, 4.0), rows)[0] == [(1, "endpoint", None), (2, "partial", "a"), (2, "final", "a"), (2, "endpoint", None)]


def test_a_silent_stream_ends_by_its_timer():
    session, handle = stt.Session(2.0, 50.0, expires=10.0), Handle()
    session.init(handle)
    frame = lambda s, seq, text: iter([pd.DataFrame([(int(s * 1e6), seq, "audio", text)], columns=session.schema.names)])
    rows = lambda parts: [tuple(r)[1:] for pdf in parts for r in pdf.itertuples(index=False)]
    assert rows(session.handleInputRows((1,), frame(0.5, 0, "a"), Time(0))) == [] and handle.timers == [1000]
    assert rows(session.handleInputRows((1,), frame(1.25, 1, "b"), Time(1000))) == [(0, "partial", "a")] and handle.timers == [2000]
    assert rows(session.handleExpiredTimer((1,), Time(2000), None)) == [(1, "partial", "b")]
    assert handle.timers == [3251]  # the last frame and the gap
    assert rows(session.handleExpiredTimer((1,), Time(3251), None)) == [(1, "final", "b"), (1, "endpoint", None)]
    assert not handle.value.exists() and not handle.timers


def test_recorded_and_streamed_frames_are_cut_alike(spark):
    rng = random.Random(3)
    rules, rows, at = stt.Rules(2.0, 9.0, 4.0), [], 0.0
    for k in range(300):
        at += rng.choice([0.5, 1.0, 1.5, 2.5, 5.0])
        rows.append((at, k, "audio", rng.choice(["x", "y", None, None])))
    ended = [seq for seq, kind, _ in fed(stt.Session(2.0, 9.0, 4.0), rows)[0] if kind == "endpoint"]
    frames = spark.createDataFrame([(1, START + dt.timedelta(seconds=s), k, said is not None) for s, k, _, said in rows], "stream_id long, ts timestamp, seq long, said boolean")
    got = stt.utterances(frames.repartition(3), rules).orderBy("utterance").collect()
    assert [r.utterance for r in got] == list(range(1, len(got) + 1)) and sum(r.frames for r in got) == 300
    last = np.cumsum([r.frames for r in got]) - 1
    assert ended == last.tolist() and {r.reason for r in got} >= {"silence", "length"}


def test_rows_are_given_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(stt, "GIVEN", 10)
    frames = [(k * 100_000, k, "audio", f"t{k}") for k in range(500)]
    session = stt.Session(20, 10**6, 25)
    handle = Handle()
    session.init(handle)
    list(session.handleInputRows((1,), iter([pd.DataFrame(frames, columns=session.schema.names)]), Time(0)))
    sizes = [len(pdf) for pdf in session.handleExpiredTimer((1,), Time(60_000), None)]
    assert sum(sizes) == 500 and max(sizes) <= 20


def wave(text, model, gaps):
    """PCM of letters, each two chunks long, with chunks of silence after each."""
    t = np.arange(2 * model.chunk) / model.rate
    parts = []
    for letter, gap in zip(text, gaps, strict=True):
        parts += [8000 * np.sin(2 * np.pi * (model.lowest + model.step * model.letters.index(letter)) * t), np.zeros(gap * model.chunk)]
    return np.concatenate(parts).round().astype(np.int16)


def test_tones_read_back():
    model = Tones("abcdefghij")
    memory, text = model.fresh(), ""
    x = wave("abbcaj", model, [0, 1, 0, 3, 0, 2])
    for at in range(0, len(x), model.chunk):
        memory, text, speech_ = model.decode(memory, x[at : at + model.chunk].tobytes())
        assert speech_ == bool(x[at : at + model.chunk].any())
    assert text == "abbcaj"
    assert len(memory) < 100 and model.decode(model.fresh(), bytes(2 * model.chunk))[1:] == ("", False)


@pytest.mark.parametrize("sizes", [(640,), (1,), (50, 999, 3), (10**6,)])
def test_pcm_cut_in_any_way_is_heard_alike(sizes):
    model = RECOGNIZERS["tones"]()
    x = wave("abcabcxyz", model, [0, 3, 20, 0, 0, 70, 2, 2, 25])
    x = np.concatenate([x, np.zeros(45 * model.chunk, np.int16)])
    if sizes == (1,):
        x = x[: 3 * model.chunk]
    at, frames, turn = 0, [], 0
    while at < len(x):
        n = sizes[turn % len(sizes)]
        frames.append((turn * 10_000, turn, "audio", x[at : at + n].tolist()))
        at, turn = at + n, turn + 1
    batches = [frames[k : k + 100] for k in range(0, len(frames), 100)]
    rows, handle, _ = played(stt.Hearing("tones", stt.Rules(0.8, 20.0, 2.4)), batches, 1)
    if sizes == (1,):
        assert rows == [(0, "partial", "a"), (2, "partial", "ab")]
        return
    starts, place = [], 0
    for gap in [0, 3, 20, 0, 0, 70, 2, 2, 25]:
        starts.append(place)
        place += 2 + gap
    want = [(starts[0], "partial", "a"), (starts[1], "partial", "ab"), (starts[2], "partial", "abc"), (starts[2] + 21, "final", "abc"), (starts[2] + 21, "endpoint", None)]
    want += [(starts[3], "partial", "a"), (starts[4], "partial", "ab"), (starts[5], "partial", "abc"), (starts[5] + 21, "final", "abc"), (starts[5] + 21, "endpoint", None)]
    want += [(starts[6], "partial", "x"), (starts[7], "partial", "xy"), (starts[8], "partial", "xyz"), (starts[8] + 21, "final", "xyz"), (starts[8] + 21, "endpoint", None)]
    # 50 chunks of silence are left after each last endpoint but one: under 2.4 seconds; at the end 50 are, too
    assert rows == want
    assert not handle.value.exists()


def test_longest_utterance_long_silence_reset_and_close():
    model = RECOGNIZERS["tones"]()
    silence = np.zeros(61 * model.chunk, np.int16).tolist()
    word = wave("ab", model, [0, 0]).tolist()
    heard = lambda *frames, rules=stt.Rules(0.8, 20.0, 2.4): played(stt.Hearing("tones", rules), [[(k * 10_000, k, kind, pcm) for k, (kind, pcm) in enumerate(frames)]], 1)[0]
    assert heard(("audio", silence)) == [(59, "endpoint", None)]
    assert heard(("audio", word), ("reset", None), ("audio", word)) == [(0, "partial", "a"), (2, "partial", "ab"), (4, "partial", "a"), (6, "partial", "ab")]
    assert heard(("audio", word), ("close", None), ("audio", word)) == [(0, "partial", "a"), (2, "partial", "ab"), (0, "partial", "a"), (2, "partial", "ab")]
    short = heard(("audio", word), ("audio", None), ("audio", []), rules=stt.Rules(0.8, 0.12, 2.4))
    assert short == [(0, "partial", "a"), (2, "partial", "ab"), (2, "final", "ab"), (2, "endpoint", None), (3, "partial", "b")]


def test_shuffled_files_through_spark(spark, tmp_path):
    """Many micro-batches, each frame up to its lateness out of place, against one pass over the sorted frames."""
    frames = {stream: speech(120, stream) for stream in (1, 2, 3)}
    rng = random.Random(9)
    every = sorted(((us + rng.uniform(0, 50e6), stream, us, seq, kind, text) for stream, rows in frames.items() for us, seq, kind, text in rows))
    every.append((0, 4, 10**11, 0, "audio", "late enough to let all others out"))
    for k in range(0, len(every), 60):
        with open(f"{tmp_path}/{k:05}.json", "w") as f:
            f.writelines(json.dumps({"stream_id": s, "ts": (START + dt.timedelta(microseconds=us)).isoformat(), "seq": seq, "type": kind, "text": text}) + "\n" for _, s, us, seq, kind, text in every[k : k + 60])
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stream = own.readStream.schema(stt.FRAMES).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path), pathGlobFilter="*.json")
    home = f"{tmp_path}/{uuid.uuid4().hex}"
    stt.run_now(stt.sessions(stream, 20, 100, 25, late=60), home)
    got = spark.read.schema(stt.OUTPUT).parquet(f"{home}/out").collect()
    for s, rows in frames.items():
        want = plain([(us, seq, kind, text) for us, seq, kind, text in rows], 20, 100, 25)
        assert sorted(((r.seq, r.type, r.text) for r in got if r.stream_id == s), key=repr) == sorted(want, key=repr)


def test_recordings_are_transcribed(spark):
    model = RECOGNIZERS["tones"]()
    say = lambda text, gaps: (wave(text, model, gaps) / 32768).tolist()
    rows = [
        (1, 16_000, say("hello", [0, 0, 1, 0, 8]), None), (2, 16_000, [0.0] * 8000, None), (3, 16_000, [0.0] * 7999, None), (4, 8_000, [0.0] * 8000, None),
        (5, None, None, "no audio data"), (6, 16_000, None, None), (7, 16_000, say("ab", [0, 9])[:-37] + [math.nan], None), (None, 16_000, say("abc", [0, 0, 9]), None),
    ]
    df = spark.createDataFrame(rows, "path long, rate int, samples array<double>, error string").repartition(3)
    got = {r.path: (r.text, r.error) for r in transcribed(df, "tones").collect()}
    assert got[1] == ("hello", None) and got[2] == ("", None) and got[7] == ("ab", None) and got[None] == ("abc", None)
    assert got[3] == (None, "Audio too short (0.5s, need at least 0.5s)") and got[4][0] is None and "rate" in got[4][1]
    assert got[5] == got[6] == (None, "no audio data")
