"""Queries over audio and streams of speech frames; events stand for frames of a user's stream."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.functions import audio
from glintframe.plans.registry import query
from glintframe.sources.tables import BATCH_BYTES, shared_folder, spread, table

#: Silence that ends an utterance with a text, and one without; the longest utterance: in seconds, at the pace of the events table.
GAP, IDLE, LONGEST = 20_000, 60_000, 100_000
_SESSIONS = f"""e AS (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS s FROM events),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY ts) > {GAP} OR lag(s) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", f"{GAP} seconds").alias("w"))


@query(f"WITH {_SESSIONS} SELECT user_id, epoch_us(min(ts)) AS began_us, epoch_us(max(ts)) AS ended_us, count(*) AS frames FROM i GROUP BY user_id, island")
def stt_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances: frames no further than the silence apart (a gap of exactly that length still joins)."""
    found = _islands(spark, sf_dir).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("frames"))
    return found.select("user_id", F.unix_micros("a").alias("began_us"), F.unix_micros("b").alias("ended_us"), "frames")


@query(f"WITH {_SESSIONS}, f AS (SELECT user_id, epoch_us(max(ts)) AS ended_us, arg_max(event_type, ts) AS text FROM i GROUP BY user_id, island) SELECT user_id, ended_us, text FROM f WHERE text <> 'error'")
def stt_final_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each utterance; an empty one (an error frame) gives no final."""
    found = _islands(spark, sf_dir).agg(F.max("ts").alias("b"), F.max_by("event_type", "ts").alias("text")).where("text != 'error'")
    return found.select("user_id", F.unix_micros("b").alias("ended_us"), "text")


@query("WITH p AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) SELECT event_id, user_id, event_type AS text FROM p WHERE before IS NULL OR before <> event_type")
def stt_partial_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial texts, only where they change."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts"))
    rows = _events(spark, sf_dir).withColumn("before", before)
    return rows.where("before is null or before != event_type").select("event_id", "user_id", F.col("event_type").alias("text"))


def _walk_sql(idle: float) -> str:
    """Frame by frame: whether this one starts an utterance, when that began, whether it has a text, whether it is over."""
    cut = f'(w."over" OR f.s - w.s > CASE WHEN w.said THEN {GAP} ELSE {idle} END)'
    return f"""f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) / 1000000.0::DOUBLE AS s, event_type <> 'error' AS said FROM events),
w(user_id, k, s, u, began, said, "over", why) AS (
  SELECT user_id, k, s, 1::BIGINT, s, said, false, CAST(NULL AS VARCHAR) FROM f WHERE k = 1
  UNION ALL
  SELECT f.user_id, f.k, f.s, CASE WHEN {cut} THEN w.u + 1 ELSE w.u END, CASE WHEN {cut} THEN f.s ELSE w.began END, f.said OR (w.said AND NOT {cut}),
    f.s - CASE WHEN {cut} THEN f.s ELSE w.began END >= {LONGEST}, CASE WHEN {cut} THEN CASE WHEN w."over" THEN 'length' ELSE 'silence' END END
  FROM w JOIN f ON f.user_id = w.user_id AND f.k = w.k + 1),
u AS (SELECT user_id, u, min(s) AS began, max(s) AS ended, count(*) AS frames, bool_or(said) AS said, bool_or("over") AS over_ FROM w GROUP BY user_id, u),
r AS (SELECT u.*, coalesce(n.why, CASE WHEN over_ THEN 'length' ELSE 'open' END) AS reason FROM u LEFT JOIN w n ON n.user_id = u.user_id AND n.u = u.u + 1 AND n.why IS NOT NULL)"""


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("said"))


@query(f"WITH RECURSIVE {_walk_sql(GAP)} SELECT user_id, u AS part, frames, round(ended - began, 3) AS age, reason FROM r")
def stt_max_length_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances that end by silence, or at the first frame that reaches the longest duration; the next frame starts anew."""
    from glintframe.streaming.stt import Rules, utterances

    rows = utterances(_recorded(spark, sf_dir), Rules(GAP, LONGEST, GAP))
    return rows.select(F.col("stream_id").alias("user_id"), F.col("utterance").alias("part"), "frames", F.round(F.col("ended") - F.col("began"), 3).alias("age"), "reason")


@query(f"WITH RECURSIVE {_walk_sql(IDLE)} SELECT user_id, u AS part, frames, said, round(ended - began, 3) AS age, reason FROM r")
def stt_endpoint_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three rules: a long silence ends any utterance, a shorter one an utterance that has a text, and so does its duration."""
    from glintframe.streaming.stt import Rules, utterances

    rows = utterances(_recorded(spark, sf_dir), Rules(GAP, LONGEST, IDLE))
    return rows.select(F.col("stream_id").alias("user_id"), F.col("utterance").alias("part"), "frames", "said", F.round(F.col("ended") - F.col("began"), 3).alias("age"), "reason")


#: Seconds that frames may come late.
LATE = 60
#: Frames of the events, and the time up to which the stream's watermark lets them out: whole seconds that it has passed.
_RELEASED = f"""m AS (SELECT max(epoch_ms(ts)) - {LATE * 1000} AS w FROM events),
f AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS s, w / 1000.0::DOUBLE AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM events, m WHERE (epoch_us(ts) // 1000000 + 1) * 1000 <= w)"""


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, DataFrame]:
    """A session of its own, whose state is kept in RocksDB, and the events as a stream in it."""
    from glintframe.streaming import stt

    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    frames = own.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    # dealt by slot before frames are made of events, so a file in one piece is many tasks; the stateful operator deals its frames once more
    frames = frames.select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    return own, stt.slotted(frames).repartition(int(own.conf.get("spark.sql.shuffle.partitions")), "slot")


@query(f"""WITH RECURSIVE {_RELEASED},
w(user_id, k, seq, s, now, text, began, "silent", part, "full") AS (
  SELECT user_id, k, event_id, s, now, CASE WHEN event_type = 'error' THEN '' ELSE event_type END, CASE WHEN event_type <> 'error' THEN s END, false, CASE WHEN event_type <> 'error' THEN event_type END, false FROM f WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, s, now, CASE WHEN event_type = 'error' OR s - coalesce(b, s) >= {LONGEST} THEN '' ELSE event_type END,
    CASE WHEN event_type <> 'error' AND s - coalesce(b, s) < {LONGEST} THEN coalesce(b, s) END, cut, CASE WHEN event_type <> 'error' AND event_type <> t THEN event_type END, event_type <> 'error' AND s - coalesce(b, s) >= {LONGEST}
  FROM (SELECT f.*, w.began IS NOT NULL AND f.s - w.s > {GAP} AS cut, CASE WHEN w.began IS NOT NULL AND f.s - w.s > {GAP} THEN '' ELSE w.text END AS t, CASE WHEN w.began IS NULL OR f.s - w.s <= {GAP} THEN w.began END AS b
    FROM w JOIN f ON f.user_id = w.user_id AND f.k = w.k + 1)),
e AS (SELECT p.user_id, p.seq, p.text FROM w n JOIN w p ON p.user_id = n.user_id AND p.k = n.k - 1 WHERE n."silent"
  UNION ALL SELECT w.user_id, w.seq, f.event_type FROM w JOIN f USING (user_id, k) WHERE w."full"
  UNION ALL SELECT user_id, seq, text FROM w WHERE k = (SELECT max(k) FROM w z WHERE z.user_id = w.user_id) AND began IS NOT NULL AND now - s > {GAP})
SELECT user_id AS stream_id, seq, 'partial' AS type, part AS text FROM w WHERE part IS NOT NULL
UNION ALL SELECT user_id, seq, 'final', text FROM e UNION ALL SELECT user_id, seq, 'endpoint', NULL FROM e""")
def stt_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of speech frames through the stateful session operator; all that is there is taken once."""
    from glintframe.streaming import stt

    _, frames = _streamed(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "reset").otherwise("audio")
    frames = frames.select("slot", "stream_id", "ts", F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("text"))
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stt.run_now(stt.sessions(frames, GAP, LONGEST, IDLE, late=LATE), home)
    return spark.read.schema(stt.OUTPUT).parquet(f"{home}/out")


#: Chunks of an event's tone, and chunks of silence (of 0.04 seconds) that end an utterance.
TONE, PAUSE = 2, 20


@query(f"""WITH {_RELEASED},
p AS (SELECT *, event_id % 30 AS rest, CAST(sum({TONE} + event_id % 30) OVER (PARTITION BY user_id ORDER BY k) AS BIGINT) - {TONE} - event_id % 30 AS chunk,
  substr(event_type, 1, 1) AS letter FROM f),
q AS (SELECT *, letter = lag(letter) OVER o AND lag(rest) OVER o = 0 AS merged, coalesce(sum(CASE WHEN rest >= {PAUSE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM p WINDOW o AS (PARTITION BY user_id ORDER BY k)),
t AS (SELECT *, string_agg(CASE WHEN coalesce(merged, false) THEN '' ELSE letter END, '') OVER (PARTITION BY user_id, u ORDER BY k) AS text FROM q)
SELECT user_id AS stream_id, chunk, 'partial' AS type, text FROM t WHERE NOT coalesce(merged, false)
UNION ALL SELECT user_id, chunk + {TONE + PAUSE - 1}, 'final', text FROM t WHERE rest >= {PAUSE} UNION ALL SELECT user_id, chunk + {TONE + PAUSE - 1}, 'endpoint', NULL FROM t WHERE rest >= {PAUSE}""")
def stt_pcm_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCM frames through a streaming recognizer: each event is a tone and a silence, cut in two frames within a chunk."""
    from glintframe.streaming import stt
    from glintframe.streaming.recognizer import RECOGNIZERS

    _, frames = _streamed(spark, sf_dir)
    model = RECOGNIZERS["low tones"]()
    wave = [np.sin(np.arange(TONE * model.chunk) * (model.lowest + model.step * k) * (2 * np.pi / model.rate)) * 8000 for k in range(-1, len(model.letters))]
    tones = F.array(*(F.array(*map(F.lit, x.round().astype(int).tolist())).cast("array<short>") for x in wave))  # one below the lowest: no letter of the model's
    tone = F.get(tones, F.instr(F.lit(model.letters), F.substring("event_type", 1, 1)))
    pcm = F.concat(tone, F.array_repeat(F.lit(0).cast("short"), (F.col("event_id") % 30 * model.chunk).cast("int")))
    frames = frames.select("slot", "stream_id", "ts", "event_id", pcm.alias("pcm"))
    cut = F.array(F.slice("pcm", 1, 57), F.slice("pcm", 58, 1 << 20))
    frames = frames.select("slot", "stream_id", "ts", "event_id", F.posexplode(cut).alias("half", "pcm"))
    frames = frames.select("slot", "stream_id", "ts", (F.col("event_id") * 2 + F.col("half")).alias("seq"), F.lit("audio").alias("type"), "pcm")
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stt.run_now(stt.heard(frames, "low tones", late=LATE), home)
    return spark.read.schema(stt.HEARD).parquet(f"{home}/out")


@query("SELECT event_id, round(CAST(trunc(value * 60) - 16000 AS DOUBLE) / 32768, 8) AS a, round(CAST(event_id % 65536 - 32768 AS DOUBLE) / 32768, 8) AS b FROM events")
def pcm_to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    pcm = F.array((F.col("value") * 60).cast("int") - 16000, (F.col("event_id") % 65536 - 32768).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", audio.from_pcm16(pcm).alias("x"))
    return rows.select("event_id", F.round(F.get("x", 0), 8).alias("a"), F.round(F.get("x", 1), 8).alias("b"))


_SAMPLES = "samples AS (SELECT user_id, list(value ORDER BY ts) AS l FROM events GROUP BY user_id)"


@query(f"WITH {_SAMPLES}, m AS (SELECT user_id, l, unnest(range((len(l) + 1) // 2)) AS i FROM samples) SELECT user_id, CAST(i AS INTEGER) AS i, round((l[2 * i + 1] + coalesce(l[2 * i + 2], 0)) / 2, 6) AS x FROM m")
def mono_mixdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved stereo to mono; the last lone sample counts half.

    Samples are dealt out by ranges of (user, time), so a user with most of them is many
    tasks: a sample's number is its place in its range after the counts of the user's earlier ranges.
    """
    home = f"{shared_folder(spark)}/mono-{uuid.uuid4().hex}"
    order = ["ts", "value", "event_id"]
    ranges = table(spark, sf_dir, "events").select("user_id", *order).repartitionByRange("user_id", *order)
    ranges.withColumn("range", F.spark_partition_id()).write.parquet(home)
    rows = spark.read.parquet(home)
    counts = rows.groupBy("user_id", "range").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("user_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("user_id").alias("u"), F.col("range").alias("r"), F.coalesce(earlier, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("user_id", "range").orderBy(*order)) - 1
    placed = rows.withColumn("place", place).join(counts, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("range") == F.col("r")))
    frames = placed.groupBy("user_id", F.expr("(before + place) div 2").cast("int").alias("i")).agg(F.sum("value").alias("x"), F.count("*").alias("n"), F.count("value").alias("known"))
    return frames.select("user_id", "i", F.round(F.when(F.col("n") == F.col("known"), F.col("x") / 2), 6).alias("x"))


# The header of a WAV file of 16-bit stereo at 16,000 frames a second, with 8 bytes of samples.
_WAV_HEAD = "524946462C00000057415645666D74201000000001000200803E000000FA0000040010006461746108000000"


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 16000 END AS rate, CASE WHEN event_id % 10 <> 0 THEN ((event_id % 30000) + (event_id % 7)) / 65536.0::DOUBLE END AS a, CASE WHEN event_id % 10 <> 0 THEN ((event_id % 11) + (event_id % 20000)) / 65536.0::DOUBLE END AS b, event_id % 10 = 0 AS failed FROM events")
def wav_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two stereo frames, read and mixed to mono; a file cut within its header gives an error row."""
    low = lambda n: F.concat(F.substring(F.lpad(F.hex(n), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(n), 4, "0"), 1, 2))
    samples = [low(F.col("event_id") % m) for m in (30000, 7, 11, 20000)]
    whole = F.unhex(F.concat(F.lit(_WAV_HEAD), *samples))
    content = F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    found = audio.wav_samples(table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), content.alias("content")))
    return found.select(F.col("path").alias("event_id"), "rate", F.get("samples", 0).alias("a"), F.get("samples", 1).alias("b"), F.col("error").isNotNull().alias("failed"))


_LETTERS = "['v', 's', 'p', 'e', 'c']"


@query(f"""WITH l AS (SELECT event_id, substr(event_type, 1, 1) AS a, {_LETTERS}[user_id % 5 + 1] AS b, {_LETTERS}[event_id % 5 + 1] AS c, event_id % 10 AS tenth FROM events)
SELECT event_id, CASE tenth WHEN 3 THEN NULL WHEN 4 THEN round(0.48::DOUBLE, 3) ELSE round(0.72::DOUBLE, 3) END AS seconds, CASE WHEN tenth NOT IN (3, 4) THEN a || CASE WHEN b <> a THEN b ELSE '' END || CASE WHEN c <> b THEN c ELSE '' END END AS text,
  CASE tenth WHEN 3 THEN 'no audio data' WHEN 4 THEN 'Audio too short (0.5s, need at least 0.5s)' END AS error FROM l""")
def stt_transcribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a WAV file of three tones, read and transcribed; some files are cut, some are too short."""
    from glintframe.operators.transcribe import transcribed_files
    from glintframe.streaming.recognizer import RECOGNIZERS

    model = RECOGNIZERS["low tones"]()
    each = 6 * model.chunk
    wave = [np.sin(np.arange(each) * (model.lowest + model.step * k) * (2 * np.pi / model.rate)) * 8000 for k in range(len(model.letters))]
    tones = F.array(*(F.lit(x.round().astype("<i2").tobytes()) for x in wave))
    letters = [F.instr(F.lit(model.letters), F.substring("event_type", 1, 1)) - 1, F.col("user_id") % 5, F.col("event_id") % 5]
    tenth = F.col("event_id") % 10

    def head(count: int) -> bytes:
        """The header of a file of `count` tones, 16-bit mono."""
        size = 2 * each * count
        return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, model.rate, 2 * model.rate, 2, 16) + b"data" + struct.pack("<I", size)

    first, second, third = (F.get(tones, x.cast("int")) for x in letters)
    whole = F.when(tenth == 4, F.concat(F.lit(head(2)), first, second)).otherwise(F.concat(F.lit(head(3)), first, second, third))
    content = F.when(tenth == 3, F.lit(head(3)[:36])).otherwise(whole)
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 20_000)
    found = transcribed_files(events.select(F.col("event_id").alias("path"), content.alias("content")), "low tones")
    return found.select(F.col("path").alias("event_id"), F.round("seconds", 3).alias("seconds"), "text", "error")


@query("SELECT user_id, count(*) AS samples, count(*) >= 131 // 2 AS enough FROM events GROUP BY user_id")
def audio_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least half a second of samples at a rate of 131."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("samples")).withColumn("enough", F.col("samples") >= 131 // 2)


@query("WITH a AS (SELECT user_id, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM events GROUP BY user_id), n AS (SELECT *, max(last) OVER () AS now FROM a) SELECT user_id, CAST(greatest(now - last, 0) AS BIGINT) AS idle_s, round(greatest(now - last, 0) * 1000.0::DOUBLE, 1) AS idle_ms, last > 0 AND now - last >= 36000 AS evict, count(*) FILTER (WHERE last > 0 AND now - last >= 36000) OVER () AS evicted FROM n")
def idle_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots idle for ten hours or more; a clock behind the last use counts as no time."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last"))
    now = last.agg(F.max("last").alias("now"))
    rows = last.join(F.broadcast(now), F.lit(True)).withColumn("idle_s", F.greatest(F.col("now") - F.col("last"), F.lit(0))).withColumn("evict", F.expr("last > 0 and idle_s >= 36000"))
    n = rows.agg(F.count_if("evict").alias("evicted"))
    return rows.join(F.broadcast(n), F.lit(True)).select("user_id", "idle_s", F.round(F.col("idle_s") * 1000.0, 1).alias("idle_ms"), "evict", "evicted")


@query("WITH p AS (SELECT event_id, user_id, ts, CAST(floor(value / 20) AS INTEGER) AS percent, lag(CAST(floor(value / 20) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) SELECT event_id, user_id, percent, CASE WHEN percent >= 5 THEN 'ready' WHEN percent > 0 THEN 'downloading' ELSE 'pending' END AS status FROM p WHERE before IS NULL OR before <> percent")
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress frames, only where the percentage changes."""
    percent = F.floor(F.col("value") / 20).cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", percent.alias("percent"))
    rows = rows.withColumn("before", F.lag("percent").over(Window.partitionBy("user_id").orderBy("ts"))).where("before is null or before != percent")
    status = F.when(F.col("percent") >= 5, "ready").when(F.col("percent") > 0, "downloading").otherwise("pending")
    return rows.select("event_id", "user_id", "percent", status.alias("status"))


@query("""WITH c AS (SELECT event_id, user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS done, sum(value) OVER (PARTITION BY user_id) AS total FROM events),
d AS (SELECT *, lag(done) OVER (PARTITION BY user_id ORDER BY s) AS done0, lag(s) OVER (PARTITION BY user_id ORDER BY s) AS s0 FROM c)
SELECT event_id, user_id, round(CASE WHEN s - s0 > 0 THEN (done - done0) / (s - s0) END, 5) AS speed, round(least(CASE WHEN total > 0 THEN done / total * 100 ELSE 0 END, 99.9), 1) AS percent FROM d""")
def download_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes a second between polls, and the percentage, at most 99.9."""
    one = Window.partitionBy("user_id")
    by = one.orderBy("ts")
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", (F.unix_micros("ts") / 1e6).alias("s"), F.sum("value").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("done"), F.sum("value").over(one).alias("total"))
    took = F.col("s") - F.lag("s").over(by)
    rows = rows.withColumn("speed", F.when(took > 0, (F.col("done") - F.lag("done").over(by)) / took))
    percent = F.least(F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100).otherwise(0.0), F.lit(99.9))
    return rows.select("event_id", "user_id", F.round("speed", 5).alias("speed"), F.round(percent, 1).alias("percent"))
