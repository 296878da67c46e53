import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import dsp, numbers, scoring
from spanloom.operators.spans import energy_events
from spanloom.streaming import spans as stream


def tone(hz, seconds, level=0.5):
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * dsp.RATE)) / dsp.RATE)).astype(np.float32)


@pytest.mark.parametrize("hz", [110, 220, 440, 880, 1500])
def test_fundamental(hz):
    f0, periodicity = dsp.fundamental(tone(hz, 0.3))
    assert f0 == pytest.approx(hz, rel=0.02) and periodicity > 0.9


def test_noise_and_silence():
    noise = np.random.default_rng(1).normal(0, 0.1, 8000).astype(np.float32)
    assert dsp.fundamental(np.zeros(4000, np.float32)) == (0.0, 0.0) and dsp.fundamental(noise)[1] < 0.4
    spec = dsp.spectrum(dsp.frames(noise)), dsp.spectrum(dsp.frames(tone(440, 0.5)))
    assert np.median(dsp.flatness(spec[0])) > 0.3 > np.median(dsp.flatness(spec[1]))
    assert np.median(dsp.centroid(spec[1])) == pytest.approx(440, abs=60) and np.median(dsp.rolloff(spec[1])) < 700
    assert dsp.frames(np.zeros(0, np.float32)).shape[0] == 0 and dsp.frames(np.zeros(100, np.float32)).shape == (1, 512)
    assert dsp.segment_features(np.zeros(10, np.float32))["loudness"] == -60.0


def test_events_and_features(spark):
    gap = np.random.default_rng(2).normal(0, 1e-4, dsp.RATE).astype(np.float32)
    audio = np.concatenate([gap, tone(900, 0.3), gap, tone(300, 0.4), gap])
    clips = spark.createDataFrame([("v", audio.tolist()), ("quiet", gap.tolist()), ("none", None)], "video string, audio array<float>")
    events = energy_events(dsp.frame_energies(clips), ["video"], "frame", "energy", dsp.HOP / dsp.RATE)
    rows = dsp.event_features(events.join(clips, "video")).orderBy("start").collect()
    assert [r.video for r in rows] == ["v", "v"]
    assert rows[0].f0 == pytest.approx(900, rel=0.05) and rows[1].f0 == pytest.approx(300, rel=0.05)
    assert rows[0].start == pytest.approx(1.0, abs=0.06) and rows[0].end == pytest.approx(1.3, abs=0.06)


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(one(numbers.decode_size(F.lit(1920), F.lit(1080), 144))) == (256, 144)
    assert tuple(one(numbers.decode_size(F.lit(101), F.lit(99), 144))) == (100, 98)
    assert one(numbers.frames_to_time(F.lit(10), F.lit(0.0))) == 0.0 and one(numbers.seconds_to_frames(F.lit(0.5), F.lit(25.0))) == 12
    rate = lambda s: one(numbers.cosine_rate(F.lit(s), 100, 10, 1.0, 0.1))
    assert rate(0) == pytest.approx(0.1) and rate(9) == 1.0 and rate(100) == pytest.approx(0.1) and rate(55) == pytest.approx(0.55)
    assert numbers.cache_gigabytes(973, 24, 144) == pytest.approx(1.45, abs=0.01)


def test_scoring(spark):
    windows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "w int, x array<double>")
    out = {(r.w, r["class"]): r.score for r in scoring.from_linear(windows, "x", {"a": ([1.0, 0.0], 0.0), "b": ([0.0, -1.0], 2.0)}).collect()}
    assert out[1, "a"] == pytest.approx(1 / (1 + np.exp(-1))) and out[1, "b"] == 0.5 and out[2, "a"] == 0.5
    table = spark.createDataFrame([(1, "a", 0.9)], "w int, class string, score double")
    assert scoring.from_table(windows, table, ["w"]).count() == 1


def test_stream_sessions(spark, tmp_path):
    rows = [("v", f"2024-01-01 00:00:{s:02d}", x) for s, x in [(1, 0.9), (4, 0.7), (6, 0.2), (20, 0.8), (50, 0.9)]] + [("v", "2024-01-01 01:00:00", 0.9)]
    df = spark.createDataFrame(rows, "video string, t string, score double").withColumn("t", F.col("t").cast("timestamp"))
    batch = sorted(map(tuple, stream.session_spans(df, ["video"], "t", "score", 0.5).drop("start", "end").collect()))
    assert [r[1] for r in batch] == [1, 1, 1, 2]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.session_spans(live, ["video"], "t", "score", 0.5).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r.n, round(r.peak, 3)) for r in spark.table("sessions").collect())
    assert got == [(1, 0.8), (1, 0.9), (2, 0.9)]
    assert stream.windowed_totals(df, ["video"], "t").count() == 2
