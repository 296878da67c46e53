"""Small scalar functions shared by configuration and clips."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode_size(width: Column, height: Column, short_side: int) -> Column:
    """struct<width,height> with the short side at the target, never larger than the source, both even."""
    scale = F.least(F.lit(1.0), short_side / F.least(width, height))
    even = lambda x: F.greatest(F.lit(2), (F.floor(x * scale / 2.0) * 2).cast("int"))
    return F.struct(even(width).alias("width"), even(height).alias("height"))


def frames_to_time(n: Column, fps: Column) -> Column:
    return F.when(fps > 0, n / fps).otherwise(0.0)


def seconds_to_frames(seconds: Column, fps: Column) -> Column:
    return F.bround(seconds * fps, 0).cast("long")


def cosine_rate(step: Column, total: int, warmup: int, base: float, least: float) -> Column:
    """Linear warm-up, then half a cosine down to the least rate."""
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / float(max(1, total - warmup))))
    return F.when(step < warmup, base * (step + 1) / float(max(1, warmup))).otherwise(least + 0.5 * (base - least) * (1 + F.cos(F.lit(math.pi) * progress)))


def cache_gigabytes(clips: int, frames: int, side: int) -> float:
    return clips * frames * side * side * 3 / 1e9
