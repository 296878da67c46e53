"""Media dimensions: metadata that goes stale, frame requests, decoded-clip tables, audio indexes, synthetic sessions."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.dsp import RATE
from spanloom.operators.text import choose
from spanloom.schema import ACTIONS, POSTURES

#: Actions that a posture rules out, for synthetic sessions.
INCOMPATIBLE = {
    "lying_down": ["jumping", "digging", "shaking_off"], "sitting": ["jumping", "rolling", "eliminating"], "standing": ["rolling"], "walking": ["rolling", "stretching", "digging", "alert_freeze"],
    "trotting": ["rolling", "stretching", "digging", "alert_freeze", "chewing", "yawning"], "running": ["rolling", "stretching", "digging", "alert_freeze", "chewing", "yawning", "scratching", "eliminating"],
}


def cache_path(root: str, frames: int, size: int, mode: str = "span", version: int = 1) -> str:
    """The folder of a table of decoded clips: another specification is another folder, so a stale one is never read."""
    return f"{root}/v{version}-{frames}x{size}-{mode}"


def duration(n_frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, n_frames / fps).otherwise(0.0)


def stale(files: DataFrame, known: DataFrame) -> DataFrame:
    """Of files (path, modified, length) those whose metadata row is missing or of another time or size."""
    same = known.select("path", "modified", "length")
    return files.join(same, ["path", "modified", "length"], "left_anti")


def refreshed(known: DataFrame, probed: DataFrame) -> DataFrame:
    """The metadata table with probed rows in place of those of the same path."""
    return known.join(probed.select("path"), "path", "left_anti").unionByName(probed, allowMissingColumns=True)


def frames_at(requests: DataFrame, frames: DataFrame, key: str = "video", wanted: str = "frames") -> DataFrame:
    """key, position, frame and the frame's columns for requested index arrays: order and repeats are kept, and an index past
    the end takes the last frame. frames: key, frame, ..."""
    last = frames.groupBy(key).agg(F.max("frame").alias("__last"))
    asked = requests.select(key, F.posexplode(wanted).alias("position", "__i")).join(last, key)
    clamped = asked.select(key, "position", F.greatest(F.lit(0).cast("long"), F.least(F.col("__i").cast("long"), F.col("__last"))).alias("frame"))
    return clamped.join(frames.withColumn("frame", F.col("frame").cast("long")), [key, "frame"])


def audio_index(parts: list[DataFrame], key: str = "video") -> DataFrame:
    """The union of summaries, a key's row from the last part that has it."""
    if not parts:
        raise ValueError("no audio summaries")
    numbered = [p.withColumn("__n", F.lit(i)) for i, p in enumerate(parts)]
    both = numbered[0]
    for p in numbered[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in (key, "__n")]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "__n").alias("r")).select(key, "r.*")


#: What a probe tells of a container.
PROBED = "path string, n_frames long, fps double, width int, height int, duration double, error string"


def probed(files: DataFrame, probe: Callable[[str], dict]) -> DataFrame:
    """files(path) -> a PROBED row per path, by a function that runs on the executors.

    ``probe`` gets a path and returns n_frames, fps, width and height, and duration unless frames and rate give it. What it
    raises becomes the row's ``error``, which audits take as unreadable, and never ends the job.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                row = dict.fromkeys(PROBED_NAMES) | {"path": path}
                try:
                    found = probe(path)
                    row |= {k: found.get(k) for k in PROBED_NAMES[1:-1]}
                    if row["duration"] is None and row["fps"]:
                        row["duration"] = row["n_frames"] / row["fps"]
                except Exception as e:  # recorded in the row, as the contract says
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(PROBED_NAMES, kinds, strict=True))))

    return files.select("path").mapInArrow(run, PROBED)


PROBED_NAMES = [x.split()[0] for x in PROBED.split(", ")]


def thumbnail(grey: np.ndarray, rows: int = 8, columns: int = 9) -> np.ndarray:
    """Means of an even grid of cells; a frame smaller than the grid repeats its pixels."""
    at = [(np.arange(n + 1) * size / n) for size, n in zip(grey.shape, (rows, columns), strict=True)]
    low = [np.floor(x[:-1]).astype(int) for x in at]
    high = [np.maximum(np.ceil(x[1:]).astype(int), a + 1) for x, a in zip(at, low, strict=True)]
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.astype(np.float64).cumsum(0).cumsum(1)
    (a, c), (b, d) = (low[0][:, None], low[1][None, :]), (high[0][:, None], high[1][None, :])
    return (total[b, d] - total[a, d] - total[b, c] + total[a, c]) / ((b - a) * (d - c))


def clip_signatures(clips: DataFrame, frames: int = 8) -> DataFrame:
    """clips(id, height int, width int, pixels array<binary>: grey frames) -> id, words array<long>: of ``frames`` frames at even
    places the 64 bits that tell whether a cell of the 8 x 9 thumbnail is brighter than the one left of it; null without frames
    or where a frame has another size."""

    def run(batches):
        for batch in batches:
            found = []
            for height, width, pixels in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                words = [] if pixels else None
                for k in np.linspace(0, len(pixels) - 1, frames).round().astype(int) if pixels else ():
                    if len(pixels[k]) != height * width or not height * width:
                        words = None
                        break
                    small = thumbnail(np.frombuffer(pixels[k], np.uint8).reshape(height, width))
                    words.append(int(np.packbits(small[:, 1:] > small[:, :-1]).view(">i8")[0]))
                found.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "words"])

    return clips.select("id", "height", "width", "pixels").mapInArrow(run, f"id {clips.schema['id'].dataType.simpleString()}, words array<long>")


def samples_of(data: bytes, rate: int = RATE) -> np.ndarray:
    """Mono float32 samples of a PCM WAV file at the rate: channels are averaged, other rates interpolated."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        whole = raw[:, 0].astype(np.int64) - 128
    else:
        whole = sum(raw[:, i].astype(np.int64) << 8 * i for i in range(width))
        whole -= (whole >> 8 * width - 1) << 8 * width
    mono = (whole / float(1 << 8 * width - 1)).reshape(-1, channels).mean(1)
    if own != rate and len(mono):
        mono = np.interp(np.arange(int(len(mono) * rate / own)) * own / rate, np.arange(len(mono)), mono)
    return mono.astype(np.float32)


def read_audio_files(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """video, audio array<float>, has_audio, error of the WAV files under a folder, each decoded where it is read.

    A file without samples or that is no PCM WAV has no audio; the latter says why in ``error``.
    """

    def run(batches):
        for batch in batches:
            audio, error = [], []
            for content in batch.column(1):
                try:
                    audio.append(samples_of(content.as_py(), rate))
                    error.append(None)
                except (wave.Error, EOFError) as e:
                    audio.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            some = pa.array([a is not None and len(a) > 0 for a in audio])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(audio, pa.list_(pa.float32())), some, pa.array(error, pa.string())], ["video", "audio", "has_audio", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{wav,WAV}").load(path)
    return files.select("path", "content").mapInArrow(run, "video string, audio array<float>, has_audio boolean, error string")


def build_cache(clips: DataFrame, root: str, decode: Callable[[dict], bytes], frames: int, size: int) -> str:
    """Decodes clips (id, ..., split) on the executors into a Parquet table by split, in a folder of its specification.

    ``decode`` gets a row as a dict and returns bytes; what it raises becomes the row's ``error``, with null bytes, and never
    ends the job. Returns the folder.
    """
    path = cache_path(root, frames, size)
    names = clips.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema) + ", clip binary, error string"

    def run(batches):
        for batch in batches:
            clip, error = [], []
            for row in batch.to_pylist():
                try:
                    clip.append(decode(row))
                    error.append(None)
                except Exception as e:  # recorded in the row, as the contract says
                    clip.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clip, pa.binary()), pa.array(error, pa.string())], [*names, "clip", "error"])

    clips.mapInArrow(run, schema).write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def read_cache(spark: SparkSession, root: str, frames: int, size: int, labels: list[str]) -> DataFrame:
    """The usable rows of a cache of this specification whose labels are all known."""
    space = F.array(*map(F.lit, labels))
    return spark.read.parquet(cache_path(root, frames, size)).where(F.col("error").isNull() & (F.size(F.array_except("labels", space)) == 0))


def synthetic_sessions(spark: SparkSession, sessions: int, segments: int = 4, seconds: float = 2.5, fps: float = 25.0, seed: int = 0) -> DataFrame:
    """Labelled spans of made-up sessions: one posture and up to two actions it allows per segment, a frame trimmed off each side."""
    rows = spark.range(sessions * segments).select(F.floor(F.col("id") / segments).alias("s"), (F.col("id") % segments).alias("k"))
    named = rows.withColumn("video", F.format_string("session_%05d.mp4", "s"))
    at = [F.lit(seed).cast("string"), F.col("video"), F.col("k").cast("string")]
    posture = choose(F.array(*map(F.lit, POSTURES)), *at, F.lit("posture"))
    ruled_out = F.create_map(*[x for p, a in INCOMPATIBLE.items() for x in (F.lit(p), F.array(*map(F.lit, a)))])
    allowed = F.array_except(F.array(*map(F.lit, ACTIONS)), ruled_out[F.col("posture")])
    order = F.array_sort(F.transform(F.col("allowed"), lambda a: F.struct(F.md5(F.concat_ws("|", *at, a)).alias("h"), a.alias("a"))))
    count = choose(F.array(F.lit(0), F.lit(1), F.lit(2)), *at, F.lit("count"))
    acted = named.withColumn("posture", posture).withColumn("allowed", allowed).withColumn("actions", F.transform(F.slice(order, 1, count), lambda x: x["a"]))
    trim = 1.0 / fps
    return acted.select("video", F.concat(F.array("posture"), "actions").alias("labels"), (F.col("k") * seconds + trim).alias("start"), ((F.col("k") + 1) * seconds - trim).alias("end"), F.regexp_replace("video", r"\.mp4$", "").alias("group"))
