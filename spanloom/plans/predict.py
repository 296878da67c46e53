"""From scored windows to spans and per-video reports, and from exports to written splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import Config, Inference
from spanloom.operators import dedup, rules, spans as sp, splits
from spanloom.operators.joins import small
from spanloom.schema import AROUSAL_FLAGS, NOT_THE_DOG, affect_dim
from spanloom.sources.annotations import group_key, write_annotations, write_labels


def predict_spans(scores: DataFrame, thresholds: DataFrame | None = None, settings: Inference | None = None, winner: bool = False) -> DataFrame:
    """scores (video, w, t0, t1, class, score) -> video, behaviour, start, end, score, peak.

    Scores are smoothed per video and class and compared to the class's threshold (thresholds: class, threshold; else the
    setting's); with ``winner`` only a window's best class, the first by name of equals, can be active.
    """
    settings = settings or Inference()
    smooth = sp.median_smooth(scores, ["video", "class"], "w", "score", settings.smooth).drop("score").withColumnRenamed("smooth", "score")
    if thresholds is not None:
        smooth = smooth.join(small(thresholds), "class", "left")
        limit = F.coalesce("threshold", F.lit(settings.threshold))
    else:
        limit = F.lit(settings.threshold)
    masked = smooth.withColumn("mask", F.col("score") >= limit)
    if winner:
        best = smooth.groupBy("video", "w").agg(F.min(F.struct((-F.col("score")).alias("s"), "class")).alias("b")).select("video", "w", F.col("b.class").alias("best"))
        masked = masked.join(best, ["video", "w"]).withColumn("mask", F.col("mask") & (F.col("class") == F.col("best")))
    found = sp.spans_from_mask(masked, ["video", "class"], "w", "mask", settings.merge_gap, settings.min_duration)
    return found.withColumnRenamed("class", "behaviour")


def reports(spans: DataFrame, videos: DataFrame, known: int | None = None) -> DataFrame:
    """One nested row per video of ``videos`` (video, duration): spans in order, seconds by behaviour, dominant behaviour,
    arousal fraction and affect."""
    seconds = rules.time_per_behaviour(spans, ["video"])
    lists = spans.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("start", "behaviour", "end", "score", "peak"))).alias("spans"))
    by = seconds.groupBy("video").agg(F.array_sort(F.collect_list(F.struct((-F.col("seconds")).alias("o"), "behaviour", "seconds"))).alias("t"))
    by = by.select("video", F.transform("t", lambda x: F.struct(x["behaviour"].alias("behaviour"), x["seconds"].alias("seconds"))).alias("time_per_behaviour"))
    affect = rules.read_affect(spans, affect_dim(spans.sparkSession), videos, ["video"], known)
    affect = affect.select("video", F.struct(*[c for c in affect.columns if c not in ("video", "duration")]).alias("affect"))
    top = rules.dominant(seconds, ["video"]).select("video", F.col("behaviour").alias("dominant"))
    flagged = rules.arousal_fraction(spans, videos, ["video"], AROUSAL_FLAGS)
    out = videos
    for part in (lists, by, top, flagged, affect):
        out = out.join(part, "video", "left")
    return out


def translated(scores: DataFrame, events: DataFrame, videos: DataFrame, behaviour_lines: DataFrame, voice_lines: DataFrame, headlines: DataFrame, settings: Inference | None = None, known: int | None = None) -> DataFrame:
    """rules.translate from window scores and typed sound events (video, kind, start, end, seconds, f0, confidence, valence,
    arousal, concerning) of ``videos`` (video, duration)."""
    spans = predict_spans(scores, None, settings)
    seen = rules.read_affect(spans.drop("peak"), affect_dim(spans.sparkSession), videos, ["video"], known)
    heard = rules.read_audio(events, videos, ["video"])
    urgent = events.where(F.col("concerning") & ~F.col("kind").isin(NOT_THE_DOG)).groupBy("video").agg(F.max("arousal").alias("urgent_arousal"))
    parts = [r.select("video", *[F.col(c).alias(f"{name}_{c}") for c in ("valence", "arousal", "confidence")]) for name, r in (("affect", seen), ("audio", heard))]
    state = rules.blend(parts[0].join(parts[1], "video").join(urgent, "video", "left"))
    return rules.translate(spans, events, state, ["video"], behaviour_lines, voice_lines, headlines)


def explain(scores: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """probes (video, at) -> the k best classes of the window whose centre is nearest: video, at, class, score, rank."""
    windows = scores.select("video", "w", "t0", "t1").distinct()
    near = sp.nearest(probes, windows, ["video"], "at", (F.col("t0") + F.col("t1")) / 2.0, "w").select("video", "at", "w")
    return sp.top_k(near.join(scores, ["video", "w"]), ["video", "at"], [F.col("score").desc(), F.col("class")], k).select("video", "at", "class", "score", "rank")


def timeline(rows: list, duration: float, width: int = 56) -> str:
    """The spans of one video (behaviour, start, end, score) as text, a line per behaviour."""
    names = sorted({r["behaviour"] for r in rows}, key=[r["behaviour"] for r in rows].index)
    if not names:
        return "(no behaviours above threshold)"
    pad, lines = max(map(len, names)) + 1, []
    for name in names:
        line, total = [" "] * width, 0.0
        for r in (r for r in rows if r["behaviour"] == name):
            total += max(0.0, r["end"] - r["start"])
            first = max(0, int(r["start"] / max(duration, 1e-6) * width))
            for i in range(first, min(width, max(first + 1, int(r["end"] / max(duration, 1e-6) * width)))):
                line[i] = "#" if r["score"] > 0.75 else "="
        lines.append(f"{name:<{pad}}|{''.join(line)}| {total:5.1f}s")
    return "\n".join([*lines, " " * pad + "0s" + "-" * (width - 8) + f"{duration:5.1f}s"])


def write_reports(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def prepare(annotations: DataFrame, out: str, fractions: dict[str, float] | None = None, seed: int = 0, signatures: DataFrame | None = None, config: Config | None = None) -> DataFrame:
    """Writes out/<split> as JSON Lines and out/behaviours; returns the annotations with their split.

    With ``signatures`` (group, at, words array<long>, bits the same for all) groups of near-equal content are merged first,
    so copies never fall on both sides of a split.
    """
    rows = annotations.withColumn("group", group_key(F.col("group"), F.col("video")))
    if signatures is not None:
        merged = dedup.merge_duplicate_groups(signatures, "group", "at", "words", 64 * len(signatures.select("words").first()[0]), (config or Config()).audit.duplicate_distance)
        rows = rows.join(merged, "group", "left").withColumn("group", F.coalesce("canonical", "group")).drop("canonical")
    placed = rows.join(splits.make_splits(rows, "group", "labels", fractions, seed), "group")
    for name in fractions or {"train": 0.8, "val": 0.2}:
        write_annotations(placed.where(F.col("split") == name), f"{out}/{name}.jsonl")
    write_labels(placed, f"{out}/behaviours")
    return placed
