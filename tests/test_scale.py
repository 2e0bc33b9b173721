"""Steps whose cost once grew with a file's only task, a pixel or a row: the same results, dealt over many tasks."""

from __future__ import annotations

import collections
import datetime as dt
import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glintframe.operators import grid, ocr, pixels, scorer, transcribe
from glintframe.plans import all_queries, speech_queries
from glintframe.sources import images, tables
from glintframe.streaming import stt
from glintframe.streaming.recognizer import RECOGNIZERS, listened
from tests import test_streams


def one_file(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def test_a_table_in_one_file_is_many_tasks(spark, tmp_path):
    one_file(spark, f"{tmp_path}/t.parquet", [(k, "x" * k) for k in range(100)] + [(None, None)], "id long, text string")
    df = tables.spread(tables.table(spark, str(tmp_path), "t"), "id", 10)
    assert df.rdd.getNumPartitions() == 11 and df.count() == 101
    sizes = df.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 8 and max(r["count"] for r in sizes) < 30


def test_bars_are_found_in_many_tasks(spark, tmp_path):
    one_file(spark, f"{tmp_path}/documents.parquet", [(k, "x" * (k * 37)) for k in range(40)] + [(40, None)], "doc_id long, text string")
    df = all_queries.QUERIES["rotated_box_pipeline"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 4 and "transform(sequence" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.collect()
    assert len({r.doc_id for r in rows}) > 20 and 40 not in {r.doc_id for r in rows}
    for r in rows:  # a bar's centre lies in its box
        n = r.doc_id * 37
        assert abs((r.x0 + r.x2) / 2 - (40 + n % 16)) < 1.5 and abs((r.y0 + r.y2) / 2 - (26 + n % 12)) < 1.5


def test_pictures_are_scored_where_they_are_prepared(spark):
    rng = np.random.default_rng(2)
    rows = [(k, 5 + k, 7, rng.integers(0, 256, (5 + k) * 21).astype(np.uint8).tobytes()) for k in range(9)] + [(9, None, None, None)]
    pictures = spark.createDataFrame(rows, "path long, width int, height int, pixels binary")
    want = scorer.batched(pixels.prepared(pictures, "recognizer"), "linear").orderBy("path").collect()
    got = scorer.scored(pictures, "recognizer", "linear")
    assert got.orderBy("path").collect() == want and len(want) == 9
    assert "tensor" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert "scored(" in inspect.getsource(ocr.detected)


def test_mean_inside_looks_at_the_box_only():
    rng = np.random.default_rng(3)
    prob = rng.random((40, 50)).astype(np.float32)
    y, x = np.indices(prob.shape)
    for _ in range(50):
        c = grid.corners_of(*rng.uniform(-5, 55, 2), *rng.uniform(1, 20, 2), rng.uniform(-2, 2))
        turns = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(c, np.roll(c, -1, axis=0), strict=True)]
        inside = (np.max(turns, axis=0) <= 0) | (np.min(turns, axis=0) >= 0)
        assert grid.mean_inside(prob, c) == (float(prob[inside].mean()) if inside.any() else 0.0)


def test_growing_and_ends_of_rows():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (2, 9), (9, 12)):
        mask = rng.random(shape) < 0.2
        want = mask.copy()
        for y in range(1, shape[0] - 1):
            for x in range(1, shape[1] - 1):
                want[y, x] |= mask[y - 1 : y + 2, x - 1 : x + 2].any()
        assert (grid.grown(mask, 1) == want).all()
        y, x = np.nonzero(mask)
        if len(y):
            assert grid.hull(grid.ends_of_rows(x, y)).tolist() == grid.hull(np.stack([x, y], 1)).tolist()


def tones(model, *kinds):
    t = np.arange(2 * model.chunk) / model.rate
    return [(8000 * np.sin(2 * np.pi * (model.lowest + model.step * k) * t)).round().astype(np.int16) if k is not None else np.zeros(2 * model.chunk, np.int16) for k in kinds]


def test_chunks_listened_to_together_are_those_decoded_one_by_one():
    model = RECOGNIZERS["low tones"]()
    x = np.concatenate(tones(model, 0, None, 0, 3, 3, None, 4, 1))
    chunks, follow = listened(model, x.tobytes())
    assert len(chunks) == len(x) // model.chunk
    one = many = model.fresh()
    for at, chunk in enumerate(chunks):
        one, *said = model.decode(one, x[at * model.chunk : (at + 1) * model.chunk].tobytes())
        many, *heard = follow(many, chunk)
        assert (one, said) == (many, heard)
    assert said[0] == "vvecs"

    class Plain:  # a recognizer that only decodes
        chunk = 4
        decode = staticmethod(lambda memory, samples: (memory, samples.hex(), True))

    chunks, follow = listened(Plain(), bytes(range(16)))
    assert [follow(b"", c)[1] for c in chunks] == [bytes(range(8)).hex(), bytes(range(8, 16)).hex()]


def test_files_are_transcribed_in_one_pass_and_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(transcribe, "HELD", 1000)
    rows = [(k, k % 7, ("view", "search", "purchase", "error", "click")[k % 5]) for k in range(200)]
    one_file(spark, f"{tmp_path}/events.parquet", rows, "event_id long, user_id long, event_type string")
    df = all_queries.QUERIES["stt_transcribe"](spark, str(tmp_path))
    assert df.rdd.getNumPartitions() >= 4 and df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for r in df.collect():
        said = [rows[r.event_id][2][0], *("vspec"[k % 5] for k in (rows[r.event_id][1], r.event_id))]
        want = "".join(c for c, before in zip(said, ["", *said], strict=False) if c != before)
        assert r.text == (None if r.event_id % 10 in (3, 4) else want) and (r.error is None) == (r.text is not None)


class Calls(test_streams.Map):
    """A map state that counts what it is asked."""

    asked = 0

    def getValue(self, key):
        self.asked += 1
        return super().getValue(key)

    def updateValue(self, key, value):
        self.asked += 1
        super().updateValue(key, value)


def test_sparse_frames_wait_in_few_blocks(monkeypatch):
    frames = [(k * 50_000_000, k, "audio", "ab"[k % 2]) for k in range(500)]
    states = []
    monkeypatch.setattr(test_streams, "Map", lambda: states.append(Calls()) or states[-1])
    rows, handle, waiting = test_streams.played(stt.Session(60, 10**6, 90), [frames], 1)
    assert rows == test_streams.plain(frames, 60, 10**6, 90)
    assert waiting == 1 and states[0].asked < 10  # an entry a second took 1,000 calls and more


def test_blocks_are_split_between_seconds(monkeypatch):
    monkeypatch.setattr(stt, "BLOCK", 2000)
    rng = np.random.default_rng(5)
    frames = [(int(us), k, "audio", f"t{k % 7}") for k, us in enumerate(np.sort(rng.integers(0, 10**8, 800)))]
    mixed = [frames[k] for k in rng.permutation(len(frames))]
    rows, handle, waiting = test_streams.played(stt.Session(5, 50, 9), [mixed[k : k + 90] for k in range(0, 800, 90)], 200)
    assert rows == test_streams.plain(frames, 5, 50, 9) and 8 < waiting < 100 and not handle.map


def in_one_slot(processor, frames, size, late):
    """Rows by stream of frames (stream, us, seq, type, text) of streams that share a slot, in batches of size."""
    handle, out, latest = test_streams.Handle(), collections.defaultdict(list), 0
    processor.init(handle)

    def given(parts):
        for pdf in parts:
            for stream, *row in pdf.itertuples(index=False):
                out[stream].append(tuple(row))

    for at in [*range(0, len(frames), size), None]:
        now = latest // 1000 + 10**8 if at is None else max(0, latest - late * 1_000_000) // 1000
        while handle.timers and min(handle.timers) <= now:
            given(processor.handleExpiredTimer((7,), test_streams.Time(now), None))
        if at is not None:
            pdf = pd.DataFrame(frames[at : at + size], columns=["stream_id", *processor.schema.names])
            given(processor.handleInputRows((7,), iter([pdf]), test_streams.Time(now)))
            latest = max(latest, *pdf["us"])
    return out, handle


@pytest.mark.parametrize(("size", "block"), [(1, 1 << 16), (13, 600), (200, 2000), (5000, 700), (5000, 1 << 16)])
def test_streams_that_share_a_slot_keep_apart(monkeypatch, size, block):
    monkeypatch.setattr(stt, "BLOCK", block)
    streams = {k: test_streams.speech(90, k) for k in range(12)}
    rng = np.random.default_rng(8)
    every = [(k, *frame) for k, frames in streams.items() for frame in frames]
    every = [every[k] for k in np.argsort([us + rng.uniform(0, 40e6) for _, us, *_ in every])]
    got, handle = in_one_slot(stt.Session(20, 100, 25), every, size, 41)
    for k, frames in streams.items():
        assert got[k] == test_streams.plain(frames, 20, 100, 25)
    assert not handle.map and not handle.timers and not handle.value.exists()


def test_many_streams_take_few_calls_to_the_state(monkeypatch):
    states = []
    monkeypatch.setattr(test_streams, "Map", lambda: states.append(Calls()) or states[-1])
    frames = [(stream, us, seq, kind, text) for stream in range(300) for us, seq, kind, text in test_streams.speech(20, stream)]
    got, _ = in_one_slot(stt.Session(20, 100, 25), frames, 10_000, 1)
    assert all(got[stream] == test_streams.plain(test_streams.speech(20, stream), 20, 100, 25) for stream in range(300))
    assert states[0].asked < 40  # a key a stream took 600 and more


def test_frames_of_one_moment_wait_in_many_blocks(monkeypatch):
    monkeypatch.setattr(stt, "BLOCK", 500)
    frames = [(k % 3, 5_000_000, k, "audio", f"t{k}") for k in range(400)]
    got, handle = in_one_slot(stt.Session(20, 100, 25), frames[::-1], 150, 1)
    for stream in range(3):
        assert [r for r in got[stream] if r[1] == "partial"] == [(k, "partial", f"t{k}") for k in range(stream, 400, 3)]
    assert not handle.map


def test_state_has_a_key_a_slot(spark, tmp_path):
    """More streams than slots, through Spark."""
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=k % 50), k % 400, "audio", "ab"[k // 400 % 2]) for k in range(2000)] + [(2000, start + dt.timedelta(hours=9), 400, "audio", "z")]
    spark.createDataFrame(rows, "seq long, ts timestamp, stream_id long, type string, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    frames = stt.slotted(own.readStream.schema("seq long, ts timestamp, stream_id long, type string, text string").parquet(f"{tmp_path}/in"), 8).repartition(2, "slot")
    run = stt.sessions(frames, 20, 100, 25).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    first = next(p for p in run.recentProgress if p.numInputRows)
    assert first.stateOperators[0].customMetrics["numRegisteredTimers"] == 8  # 401 with a key a stream
    got = spark.read.schema(stt.OUTPUT).parquet(f"{tmp_path}/out").collect()
    for stream in (0, 7, 399):
        want = test_streams.plain([(int((t - start).total_seconds()) * 10**6, seq, kind, text) for seq, t, s, kind, text in sorted(rows, key=lambda r: (r[1], r[0])) if s == stream], 20, 100, 25)
        assert sorted(((r.seq, r.type, r.text) for r in got if r.stream_id == stream), key=repr) == sorted(want, key=repr)


def test_streams_are_dealt_before_frames_are_made(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=k), k % 3, ("view", "error", "search")[k % 4 % 3], 1.0) for k in range(90)]
    one_file(spark, f"{tmp_path}/made", rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    own, frames = speech_queries._streamed(spark, str(tmp_path))
    assert "RepartitionByExpression" in frames._jdf.queryExecution().analyzed().toString() and "value" not in frames.columns
    assert all_queries.QUERIES["stt_pcm_stream"](spark, str(tmp_path)).where("type = 'partial'").count() > 3


def test_hulls_of_many_sets_at_once():
    rng = np.random.default_rng(6)
    for n, size, top in ((40, 1, 9), (40, 2, 3), (200, 3, 4), (300, 7, 6), (20, 60, 9), (5, 12, 4)):
        sets = rng.integers(0, top, (n, size, 2))
        seen = []
        for at, found in grid.hulls(sets):
            seen += at.tolist()
            rectangles, corners = grid.tight_rectangles(found), grid.sharpest_of(found) if found.shape[1] >= 4 else None
            for k, one in enumerate(found):
                assert one.tolist() == grid.hull(sets[at[k]]).tolist()
                assert tuple(rectangles[k].tolist()) == grid.tight_rectangle(one)
                if corners is not None:
                    assert [(x, y) for _, x, y in grid.sharpest(one)] == [tuple(c) for c in corners[k].tolist()]
        assert sorted(seen) == list(range(n))


def test_many_perspectives_are_those_of_each():
    rng = np.random.default_rng(7)
    source, target = rng.integers(0, 4, (300, 4, 2)).astype(float), rng.integers(0, 9, (300, 4, 2)).astype(float)
    got, known = grid.perspectives(source, target)
    for k in range(300):
        one = grid.perspective(source[k], target[k])
        assert known[k] == (one is not None) and (one is None or got[k].tolist() == one.tolist())
    assert 0 < known.sum() < 300


def test_blocks_of_any_size_are_unfiltered_together():
    rng = np.random.default_rng(8)
    blocks, want = [], []
    for k in range(60):
        step, high, wide = (1, 3, 4)[k % 3], int(rng.integers(1, 30)), int(rng.integers(1, 40))
        lines, kinds = rng.integers(0, 256, (high, wide * step)).astype(np.uint8), rng.integers(0, 5, high)
        blocks.append((images.filtered(lines, kinds, step), kinds, step))
        want.append(lines.tolist())
    assert [b.tolist() for b in images.unfiltered_all(blocks)] == want
    assert [images.unfiltered(*b).tolist() for b in blocks] == want


def test_pictures_in_one_file_are_many_tasks(spark, tmp_path):
    one_file(spark, f"{tmp_path}/documents.parquet", [(k, "abc" * (k * 5)) for k in range(60)] + [(60, None)], "doc_id long, text string")
    for name in ("image_decode", "image_tensor", "image_prep", "scorer_batched"):
        df = all_queries.QUERIES[name](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 4
    assert all_queries.QUERIES["image_decode"](spark, str(tmp_path)).where("invalid").count() == 6


def test_summaries_are_those_of_the_prepared_tensors(spark):
    rng = np.random.default_rng(9)
    rows = [(k, 4 + k, 9, rng.integers(0, 256, (4 + k) * 27).astype(np.uint8).tobytes()) for k in range(6)] + [(6, None, None, None)]
    pictures = spark.createDataFrame(rows, "path long, width int, height int, pixels binary")
    want = {r.path: r.tensor and bytes(r.tensor) for r in pixels.prepared(pictures, "face").collect()}
    got = pixels.summarized(pictures, "face", "tensor binary", lambda t: [(None if t is None else t.tobytes(),)])
    assert {r.path: r.tensor and bytes(r.tensor) for r in got.collect()} == want and want[6] is None and len(want) == 7


def test_dense_tables_resize_as_banded_ones_do(monkeypatch):
    rng = np.random.default_rng(10)
    images_ = [rng.integers(0, 256, (h, w, 3)).astype(np.uint8) for h, w in ((1, 32), (7, 32), (40, 32), (400, 32), (36, 31))]
    got = [pixels.resized(x, 112, 50) for x in images_]
    assert pixels.dense(32, 112) is not None and pixels.dense(4000, 224) is None
    monkeypatch.setattr(pixels, "dense", lambda have, want: None)
    assert all((a == pixels.resized(x, 112, 50)).all() for a, x in zip(got, images_, strict=True))


def test_tensors_stay_in_their_task(spark, tmp_path):
    one_file(spark, f"{tmp_path}/documents.parquet", [(k, "abc" * k) for k in range(5)], "doc_id long, text string")
    for name in ("image_prep", "image_tensor", "scorer_batched"):
        plan = all_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "tensor" not in plan and "MapInPandas" not in plan
