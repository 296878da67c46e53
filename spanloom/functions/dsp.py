"""Signal features of mono audio in numpy, and the Arrow functions that compute them per clip on the executors.

Frames have FRAME samples every HOP; frames that the end would cut are filled with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE, FRAME, HOP = 16000, 512, 160
#: The range of fundamentals looked for, in Hz.
LOWEST, HIGHEST = 70.0, 1800.0


def frames(audio: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    n = 1 + max(0, -(-(len(audio) - size) // hop)) if len(audio) else 0
    padded = np.concatenate([audio, np.zeros(max(0, (n - 1) * hop + size - len(audio)), audio.dtype)]) if n else audio
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:n] if n else np.zeros((0, size), audio.dtype)


def spectrum(framed: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(framed * np.hanning(framed.shape[1]), axis=1))


def loudness_db(framed: np.ndarray) -> np.ndarray:
    return 20 * np.log10(np.sqrt((framed.astype(np.float64) ** 2).mean(1)) + 1e-10)


def centroid(spec: np.ndarray, rate: int = RATE) -> np.ndarray:
    f = np.fft.rfftfreq((spec.shape[1] - 1) * 2, 1 / rate)
    return (spec * f).sum(1) / (spec.sum(1) + 1e-12)


def flatness(spec: np.ndarray) -> np.ndarray:
    power = spec**2 + 1e-12
    return np.exp(np.log(power).mean(1)) / power.mean(1)


def rolloff(spec: np.ndarray, rate: int = RATE, fraction: float = 0.95) -> np.ndarray:
    f = np.fft.rfftfreq((spec.shape[1] - 1) * 2, 1 / rate)
    total = np.cumsum(spec, 1)
    return f[np.minimum((total < fraction * total[:, -1:]).sum(1), len(f) - 1)]


def fundamental(segment: np.ndarray, rate: int = RATE, low: float = LOWEST, high: float = HIGHEST) -> tuple[float, float]:
    """(Hz, periodicity 0 to 1) from the normalised autocorrelation: the first lag whose peak comes near the highest; (0, 0) if none."""
    x = segment.astype(np.float64) - segment.mean() if len(segment) else segment
    shortest, longest = int(rate / high), min(int(rate / low), len(x) - 2)
    if longest <= shortest or not np.any(x):
        return 0.0, 0.0
    size = 1 << (2 * len(x) - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)) ** 2
    auto = np.fft.irfft(power, size)[: longest + 2] / np.maximum(len(x) - np.arange(longest + 2), 1)
    auto /= auto[0] + 1e-12
    lags = np.arange(max(shortest, 1), longest + 1)
    peaks = lags[(auto[lags] > auto[lags - 1]) & (auto[lags] >= auto[lags + 1])]
    if not len(peaks):
        return 0.0, 0.0
    best = auto[peaks].max()
    if best < 0.2:
        return 0.0, float(max(0.0, best))
    lag = peaks[np.flatnonzero(auto[peaks] >= 0.9 * best)[0]]
    a, b, c = auto[lag - 1 : lag + 2]
    shift = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c else 0.0
    return float(rate / (lag + shift)), float(min(1.0, b))


def frame_energies(clips: DataFrame, key: str = "video", audio: str = "audio") -> DataFrame:
    """key, frame long, energy double of float sample arrays: what operators.spans.energy_events reads."""
    kind = clips.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k, samples in zip(batch.column(0), batch.column(1), strict=True):
                level = loudness_db(frames(np.asarray(samples.as_py() or [], np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(level), batch.schema.field(0).type), pa.array(np.arange(len(level))), pa.array(level)], [key, "frame", "energy"])

    return clips.select(key, audio).mapInArrow(run, f"`{key}` {kind}, frame long, energy double")


FEATURES = ["seconds", "f0", "periodicity", "flatness", "centroid", "loudness", "modulation", "formant", "high"]


def segment_features(segment: np.ndarray, rate: int = RATE) -> dict[str, float]:
    """FEATURES of one event's samples, as operators.rules.voice_kind reads them."""
    if len(segment) < 32:
        return dict(zip(FEATURES, (len(segment) / rate, 0.0, 0.0, 1.0, 0.0, -60.0, 0.0, 0.0, 0.0), strict=True))
    framed = frames(segment, min(FRAME, len(segment)))
    spec = spectrum(framed)
    f0, periodicity = fundamental(segment, rate)
    step = max(1, len(segment) // 6)
    tried = [fundamental(segment[i : i + step], rate) for i in range(0, max(1, len(segment) - step), step)]
    pitches = [p for p, clear in tried if p > 0 and clear > 0.3]
    mean = spec.mean(0)
    f = np.fft.rfftfreq((spec.shape[1] - 1) * 2, 1 / rate)
    total = mean.sum() + 1e-12
    return {
        "seconds": len(segment) / rate, "f0": f0, "periodicity": periodicity, "flatness": float(np.median(flatness(spec))), "centroid": float(np.median(centroid(spec, rate))),
        "loudness": float(loudness_db(framed).max()), "modulation": float(np.std(pitches) / max(1.0, np.mean(pitches))) if len(pitches) > 2 else 0.0,
        "formant": float(mean[(f >= 300) & (f <= 3400)].sum() / total), "high": float(mean[f > 4000].sum() / total),
    }


def event_features(events: DataFrame, rate: int = RATE, key: str = "video") -> DataFrame:
    """events(key, start, end, audio array<float>) -> key, start, end and FEATURES; the samples stay on the executors."""
    kind = events.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for start, end, samples in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                audio = np.asarray(samples or [], np.float32)
                rows.append(segment_features(audio[max(0, int(start * rate)) : min(len(audio), int(end * rate))], rate))
            columns = [pa.array([r[f] for r in rows], pa.float64()) for f in FEATURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], [key, "start", "end", *FEATURES])

    schema = f"`{key}` {kind}, start double, end double, " + ", ".join(f"{f} double" for f in FEATURES)
    return events.select(key, "start", "end", "audio").mapInArrow(run, schema)
