"""Spans from streams: score windows as they arrive become spans, sessions close on a gap and late rows follow a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_spans(scores: DataFrame, key: list[str], time: str, score: str, threshold: float, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """key, start, end, n, score, peak: rows at the threshold or above, at most ``gap`` apart, as one session.

    Works on a stream (append mode: a session is emitted once the watermark passes its end) and on a table. The state is one
    row per open session, whatever its number of rows.
    """
    marked = scores.withWatermark(time, late) if scores.isStreaming else scores
    session = F.session_window(time, gap)
    grouped = marked.where(F.col(score) >= threshold).groupBy(*key, session.alias("session"))
    out = grouped.agg(F.count("*").alias("n"), F.avg(score).alias("score"), F.max(score).alias("peak"), F.min(time).alias("first"), F.max(time).alias("last"))
    return out.select(*key, F.col("first").alias("start"), F.col("last").alias("end"), "n", "score", "peak")


def windowed_totals(spans: DataFrame, key: list[str], time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """key, window_start, n: tumbling counts of rows by event time."""
    marked = spans.withWatermark(time, late) if spans.isStreaming else spans
    return marked.groupBy(*key, F.window(time, width).alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("window_start"), "n")
