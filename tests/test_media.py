import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.schema import ACTIONS, POSTURES
from spanloom.sources import media


def test_stale_and_refreshed(spark):
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 30)], "path string, modified long, length long")
    known = spark.createDataFrame([("a", 1, 10, 25.0), ("b", 1, 20, 25.0)], "path string, modified long, length long, fps double")
    old = media.stale(files, known)
    assert sorted(r.path for r in old.collect()) == ["b", "c"]
    now = media.refreshed(known, old.withColumn("fps", F.lit(30.0)))
    assert sorted((r.path, r.modified, r.fps) for r in now.collect()) == [("a", 1, 25.0), ("b", 2, 30.0), ("c", 3, 30.0)]
    assert media.stale(files, now).count() == 0


def test_frames_keep_order_and_repeats(spark):
    frames = spark.createDataFrame([("v", i, i * 10) for i in range(6)], "video string, frame int, x int")
    asked = spark.createDataFrame([("v", [3, 1, 1, 99, -2])], "video string, frames array<int>")
    assert [r.x for r in media.frames_at(asked, frames).orderBy("position").collect()] == [30, 10, 10, 50, 0]


def test_audio_index_last_wins(spark):
    a = spark.createDataFrame([("v", 0.1), ("w", 0.2)], "video string, arousal double")
    b = spark.createDataFrame([("v", 0.9, 0.5)], "video string, arousal double, confidence double")
    assert sorted(tuple(r) for r in media.audio_index([a, b]).collect()) == [("v", 0.9, 0.5), ("w", 0.2, None)]
    with pytest.raises(ValueError):
        media.audio_index([])


def test_cache_records_failures(spark, tmp_path):
    clips = spark.createDataFrame([(1, ["x"], "train"), (2, ["x"], "val"), (3, ["y"], "val")], "id long, labels array<string>, split string")

    def decode(row):
        if row["id"] == 2:
            raise OSError("cut off")
        return bytes([row["id"]])

    path = media.build_cache(clips, str(tmp_path), decode, 8, 32)
    assert path.endswith("8x32-span")
    rows = {r.id: (r.clip and bytes(r.clip), r.error) for r in spark.read.parquet(path).collect()}
    assert rows == {1: (b"\x01", None), 2: (None, "OSError: cut off"), 3: (b"\x03", None)}
    assert [r.id for r in media.read_cache(spark, str(tmp_path), 8, 32, ["x"]).collect()] == [1]


def test_synthetic_sessions(spark):
    rows = media.synthetic_sessions(spark, 30, seed=2).collect()
    assert len(rows) == 120 and sorted(map(str, rows)) == sorted(map(str, media.synthetic_sessions(spark, 30, seed=2).repartition(3).collect()))
    for r in rows:
        assert r.labels[0] in POSTURES and set(r.labels[1:]) <= set(ACTIONS) - set(media.INCOMPATIBLE[r.labels[0]]) and len(r.labels) <= 3
        assert r.end - r.start == pytest.approx(2.5 - 0.08)
    assert {len(r.labels) for r in rows} == {1, 2, 3}


def test_probes_record_what_fails(spark):
    def probe(path):
        if path == "bad":
            raise OSError("no stream")
        return {"n_frames": 50, "fps": 25.0, "width": 640, "height": 480}

    rows = {r.path: r for r in media.probed(spark.createDataFrame([("a",), ("bad",)], "path string"), probe).collect()}
    assert (rows["a"].duration, rows["a"].width, rows["a"].error) == (2.0, 640, None)
    assert rows["bad"].error == "OSError: no stream" and rows["bad"].fps is None


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_samples(width):
    tone = np.sin(np.arange(800) / 20) * 0.5
    whole = np.round(tone * (1 << 8 * width - 1)).astype(np.int64)
    raw = (whole + 128).astype(np.uint8)[:, None] if width == 1 else np.stack([(whole >> 8 * i & 255).astype(np.uint8) for i in range(width)], 1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, width, 8000, 0, "NONE", None))
        w.writeframes(np.repeat(raw, 2, axis=0).tobytes())
    assert np.abs(media.samples_of(out.getvalue(), 8000) - tone).max() < 0.01
    assert len(media.samples_of(out.getvalue(), 16000)) == 1600


def test_audio_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", None))
        w.writeframes(np.full(100, 1 << 14, "<i2").tobytes())
    with wave.open(str(tmp_path / "empty.wav"), "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", None))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    rows = {r.video.rsplit("/", 1)[1]: r for r in media.read_audio_files(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].audio == [0.5] * 100 and rows["a.wav"].has_audio
    assert not rows["empty.wav"].has_audio and rows["empty.wav"].error is None and rows["bad.wav"].error and rows["bad.wav"].audio is None


def test_clip_signatures(spark):
    r = np.random.default_rng(4)
    frames = [r.integers(0, 256, (32, 36), dtype=np.uint8) for _ in range(8)]
    brighter = [np.minimum(f.astype(int) + 3, 255).astype(np.uint8) for f in frames]
    rows = [(1, 32, 36, [f.tobytes() for f in frames]), (2, 32, 36, [f.tobytes() for f in brighter]), (3, 32, 36, [f.tobytes() for f in frames[::-1]]), (4, 32, 36, []), (5, 3, 3, [b"x"]), (6, 4, 4, [bytes(range(16))])]
    out = {r.id: r.words for r in media.clip_signatures(spark.createDataFrame(rows, "id long, height int, width int, pixels array<binary>")).collect()}
    far = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
    assert far(out[1], out[2]) <= 6 < far(out[1], out[3]) and out[4] is None and out[5] is None and len(out[6]) == 8
    cells = frames[0].reshape(8, 4, 9, 4).mean((1, 3))
    assert np.allclose(media.thumbnail(frames[0]), cells)
    bits = "".join("1" if b > a else "0" for row in cells for a, b in zip(row, row[1:]))
    assert out[1][0] & (1 << 64) - 1 == int(bits, 2)
