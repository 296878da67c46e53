"""Interval and timeline operators: windows, smoothing, runs, merging, hysteresis, interval and as-of joins.

Window functions are partitioned by the timeline's key, so timelines spread freely. Where one timeline may be too long for
a task, ``bucket`` (a width in units of its order column) makes runs, merging, hysteresis, local rates and smoothing work on
stretches of that width instead, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import longline

def window_starts(n: Column, span: Column, hop: Column) -> Column:
    """array<long> of start frames 0, hop, ... and the tail n - span; [0] when the video is not longer than a window."""
    span, hop = F.greatest(span, F.lit(1)).cast("long"), F.greatest(hop, F.lit(1)).cast("long")
    last = n.cast("long") - span
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), hop), F.array(last)))
    )


def window_hop(span: Column, fraction: Column) -> Column:
    """Frames between window starts: span times the fraction (0.05 at least), rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(span * F.greatest(fraction, F.lit(0.05)), 0).cast("int"))


def sample_indices(n: Column, clip: int, stride: int = 1, mode: str = "tsn", start: Column | None = None) -> Column:
    """array<long> of the frames an evaluation clip takes: centred segments ("tsn") or a centred dense run ("contiguous")."""
    n = n.cast("long")
    span = clip * max(1, stride)
    steps = F.sequence(F.lit(0), F.lit(clip - 1))
    clip_to = lambda x: F.greatest(F.lit(0).cast("long"), F.least(x.cast("long"), n - 1))
    if mode == "contiguous":
        begin = start if start is not None else F.floor(F.greatest(n - span, F.lit(0)) / 2)
        return F.transform(steps, lambda k: clip_to(begin + k * max(1, stride)))
    width = F.lit(span).cast("long") if start is not None else F.least(F.lit(span).cast("long"), n)
    begin = start if start is not None else F.floor(F.greatest(n - width, F.lit(0)) / 2)
    return F.transform(steps, lambda k: clip_to(F.floor(begin + (k + 0.5) * width / clip)))


def frame_range(start: Column, end: Column, fps: Column, n: Column) -> Column:
    """struct<first,last> of the frames a span covers; an empty span gets the frame at its start."""
    first = F.greatest(F.lit(0).cast("long"), F.floor(start * fps))
    last = F.least(n.cast("long") - 1, F.ceil(end * fps) - 1)
    return F.struct(F.when(last < first, F.least(n.cast("long") - 1, first)).otherwise(first).alias("first"), F.when(last < first, F.least(n.cast("long") - 1, first)).otherwise(last).alias("last"))


def median_smooth(df: DataFrame, key: list[str], order: str, value: str, width: int, out: str = "smooth", bucket: float | None = None) -> DataFrame:
    """Centred running median with the first and last value repeated beyond the ends; short timelines narrow the window.

    The window is cut to the timeline's length and made odd; timelines under three values stay as they are.
    """
    if width <= 1:
        return df.withColumn(out, F.col(value))
    half = (width + (width % 2 == 0)) // 2
    if bucket:
        return _median_in_stretches(df, key, order, value, width, out, bucket)
    whole, line = Window.partitionBy(*key), Window.partitionBy(*key).orderBy(order)
    ordered = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.select(
        "*",
        F.count("*").over(whole).alias("__n"),
        F.row_number().over(line).alias("__i"),
        F.first(value).over(ordered).alias("__first"),
        F.last(value).over(ordered).alias("__last"),
        F.collect_list(value).over(line.rowsBetween(-half, half)).alias("__near"),
    )
    return _median_of(df, value, width, half, out)


def _median_of(df: DataFrame, value: str, width: int, half: int, out: str) -> DataFrame:
    """The median of __near, the values up to ``half`` rows away of row __i of __n, padded with the line's ends."""
    room = F.greatest(F.lit(0), half - F.col("__i") + 1).cast("int"), F.greatest(F.lit(0), half - F.col("__n") + F.col("__i")).cast("int")
    padded = F.concat(F.array_repeat("__first", room[0]), F.col("__near"), F.array_repeat("__last", room[1]))
    own_width = F.least(F.lit(width).cast("long"), F.col("__n"))
    own_half = F.floor((own_width + (1 - own_width % 2)) / 2).cast("int")
    median = F.element_at(F.array_sort(F.slice(padded, half - own_half + 1, 2 * own_half + 1)), own_half + 1)
    return df.withColumn(out, F.when(F.col("__n") < 3, F.col(value)).otherwise(median)).drop("__n", "__i", "__first", "__last", "__near")


def _median_in_stretches(df: DataFrame, key: list[str], order: str, value: str, width: int, out: str, bucket: float, stretch: int = 4096) -> DataFrame:
    """median_smooth with the line cut into stretches of rows, each with the rows next to it."""
    half = (width + (width % 2 == 0)) // 2
    sized = numbered(df, key, [order], bucket, "__i")
    ends = sized.groupBy(*key).agg(F.count("*").alias("__n"), F.min_by(value, order).alias("__first"), F.max_by(value, order).alias("__last"))
    rows = sized.join(ends, key)
    at = F.floor((F.col("__i") - 1) / stretch)
    sides = F.array_distinct(F.array(at, F.floor((F.col("__i") - 1 - half) / stretch), F.floor((F.col("__i") - 1 + half) / stretch)))
    line = Window.partitionBy(*key, "__s").orderBy("__i").rowsBetween(-half, half)
    near = rows.withColumn("__s", F.explode(sides)).withColumn("__near", F.collect_list(value).over(line)).where(F.col("__s") == at).drop("__s")
    return _median_of(near, value, width, half, out)


def numbered(df: DataFrame, key: list[str], by: list[str], bucket: float | None, out: str) -> DataFrame:
    if bucket:
        return longline.row_index(df, key, by, bucket, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(*by)))


def islands(df: DataFrame, key: list[str], by: list[str], value: str, bucket: float | None, cut, out: str = "__g") -> DataFrame:
    """Adds the number of rows up to this one at which ``cut(the row before's value)`` holds or there is none before."""
    if bucket:
        rows = longline.previous(df, key, by, bucket, value, "__prev")
        return longline.running(rows, key, by, bucket, (F.col("__prev").isNull() | cut(F.col("__prev"))).cast("int"), out).drop("__prev")
    line = Window.partitionBy(*key).orderBy(*by)
    rows = df.withColumn("__prev", F.lag(value).over(line))
    return rows.withColumn(out, F.sum((F.col("__prev").isNull() | cut(F.col("__prev"))).cast("int")).over(line)).drop("__prev")


def runs(df: DataFrame, key: list[str], order: str, mask: str, score: str = "score", t0: str = "t0", t1: str = "t1", bucket: float | None = None) -> DataFrame:
    """Maximal runs of masked windows: key, start, end, score (mean), peak."""
    marked = numbered(df.select(*key, order, mask, score, t0, t1), key, [order], bucket, "__i").where(mask)
    island = numbered(marked, key, [order], bucket, "__j").withColumn("__g", F.col("__i") - F.col("__j"))
    return island.groupBy(*key, "__g").agg(
        F.min_by(t0, order).alias("start"), F.max_by(t1, order).alias("end"), F.avg(score).alias("score"), F.max(score).alias("peak")
    ).drop("__g")


def merge_spans(spans: DataFrame, key: list[str], gap: float, bucket: float | None = None) -> DataFrame:
    """Joins neighbours at most ``gap`` apart; the score is re-weighted by the duration merged so far, bridged gaps included.

    The fold is not associative, so each island of neighbours is folded in order; islands, not timelines, are the unit.
    """
    if gap <= 0:
        return spans
    joined = islands(spans, key, ["start", "end"], "end", bucket, lambda before: F.col("start") - before > gap)
    listed = joined.groupBy(*key, "__g").agg(F.array_sort(F.collect_list(F.struct("start", "end", "score", "peak"))).alias("s"))

    def step(a: Column, x: Column) -> Column:
        held, new = F.greatest(F.lit(0.0), a["end"] - a["start"]), F.greatest(F.lit(0.0), x["end"] - x["start"])
        score = F.when(held + new > 0, (a["score"] * held + x["score"] * new) / (held + new)).otherwise(a["score"])
        return F.struct(a["start"].alias("start"), x["end"].alias("end"), score.alias("score"), F.greatest(a["peak"], x["peak"]).alias("peak"))

    merged = F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0], step)
    return listed.select(*key, merged.alias("m")).select(*key, "m.*")


def spans_from_mask(df: DataFrame, key: list[str], order: str, mask: str, merge_gap: float = 0.0, min_duration: float = 0.0, bucket: float | None = None, span_bucket: float | None = None, **names) -> DataFrame:
    """runs, then merge_spans (with buckets of the order column and of span starts), then the minimum duration."""
    merged = merge_spans(runs(df, key, order, mask, bucket=bucket, **names), key, merge_gap, span_bucket)
    return merged.where(F.greatest(F.lit(0.0), F.col("end") - F.col("start")) >= min_duration)


def frame_runs(df: DataFrame, key: list[str], frame: str, gap: int = 1, bucket: float | None = None) -> DataFrame:
    """Runs of frame numbers at most ``gap`` apart, repeats collapsed: key, first, last."""
    return islands(df.select(*key, frame).distinct(), key, [frame], frame, bucket, lambda before: F.col(frame) - before > gap).groupBy(*key, "__g").agg(
        F.min(frame).alias("first"), F.max(frame).alias("last")
    ).drop("__g")


def hysteresis(df: DataFrame, key: list[str], order: str, value: str, open_level: Column, close_level: Column, bucket: float | None = None) -> DataFrame:
    """Adds ``active``: on from a value >= open until one < close."""
    line = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    switch = F.when(F.col(value) >= open_level, F.lit(True)).when(F.col(value) < close_level, F.lit(False))
    if bucket:
        return longline.carried(df, key, [order], bucket, switch, "active").withColumn("active", F.coalesce("active", F.lit(False)))
    return df.withColumn("active", F.coalesce(F.last(switch, ignorenulls=True).over(line), F.lit(False)))


def quantiles(df: DataFrame, key: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """key and a column per entry of ``at``: the interpolated quantile of the values that are not null.

    Equal to DuckDB's quantile_cont to the last bit, which is low * (1 - part) + high * part as a fused multiply-add.
    Spark's percentile rounds the first product too, so a value that equals a level may fall on the other side of it.
    """
    line = Window.partitionBy(*key)
    rows = df.select(*key, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    rows = rows.select("*", (F.row_number().over(line.orderBy("__v")) - 1).alias("__i"), (F.count("*").over(line) - 1).alias("__last"))
    ends = []
    for name, q in at.items():
        place = F.col("__last") * F.lit(float(q))
        ends.append(F.max(F.when(F.col("__i") == F.floor(place), F.col("__v"))).alias(f"{name}_low"))
        ends.append(F.max(F.when(F.col("__i") == F.ceil(place), F.col("__v"))).alias(f"{name}_high"))
        ends.append(F.max(place - F.floor(place)).alias(f"{name}_part"))

    def between(name: str) -> Column:
        low, high, part = (F.col(f"{name}_{x}") for x in ("low", "high", "part"))
        fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1.0 - part, high * part).cast("double")
        return F.when(part == 0, low).otherwise(fused).alias(name)

    return rows.groupBy(*key).agg(*ends).select(*key, *[between(name) for name in at])


def energy_events(
    df: DataFrame, key: list[str], frame: str, energy: str, seconds: float, open_db: float = 9.0, close_db: float = 5.0, gap: float = 0.06, least: float = 0.045, most: float = 4.0
) -> DataFrame:
    """Sound events of frame energies: levels above the 20th percentile, scaled by the range to the 99th (none under 3 dB)."""
    levels = quantiles(df, key, energy, {"__floor": 0.2, "__top": 0.99})
    scale = F.least(F.lit(1.0), (F.col("__top") - F.col("__floor")) / 25.0)
    levels = levels.where(F.col("__top") - F.col("__floor") >= 3.0).select(*key, (F.col("__floor") + open_db * scale).alias("__open"), (F.col("__floor") + close_db * scale).alias("__close"))
    active = hysteresis(df.join(levels, key), key, frame, energy, F.col("__open"), F.col("__close")).where("active")
    found = frame_runs(active, key, frame).select(*key, (F.col("first") * seconds).alias("start"), ((F.col("last") + 1) * seconds).alias("end"))
    return merge_gaps(found, key, gap).where(F.col("end") - F.col("start") >= least).withColumn("end", F.least(F.col("end"), F.col("start") + most))


def merge_gaps(events: DataFrame, key: list[str], gap: float, bucket: float | None = None) -> DataFrame:
    """Intervals at most ``gap`` apart as one: key, start, end (that of the last)."""
    return islands(events.select(*key, "start", "end"), key, ["start", "end"], "end", bucket, lambda before: F.col("start") - before > gap).groupBy(*key, "__g").agg(
        F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")
    ).drop("__g")


def local_rate(df: DataFrame, key: list[str], time: str, radius: float, out: str = "rate", bucket: float | None = None) -> DataFrame:
    """Adds the number of other rows of the timeline within ``radius`` of the row's time.

    In buckets (no narrower than the radius) rows near an edge are counted, but not returned, in the neighbour too.
    """
    if bucket:
        width = max(bucket, radius)
        at = F.floor(F.col(time) / width)
        sides = F.array_distinct(F.array(at, F.floor((F.col(time) - radius) / width), F.floor((F.col(time) + radius) / width)))
        copied = df.withColumn("__b", F.explode(sides))
        return local_rate(copied, [*key, "__b"], time, radius, out).where(F.col("__b") == at).drop("__b")
    keys = ", ".join(f"`{k}`" for k in key)
    near = f"count(*) OVER (PARTITION BY {keys} ORDER BY `{time}` RANGE BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) - 1"
    return df.withColumn(out, F.expr(near))


def nearest(probes: DataFrame, rows: DataFrame, key: list[str], at: str, centre: Column, order: str) -> DataFrame:
    """As-of join: for every probe the row of its key with the nearest centre, the first by ``order`` of equals.

    The probe's columns, then the row's (those that clash with the probe's are left out). Both sides are merged into one
    timeline per key and only neighbours are compared, so a probe costs no more rows than one.
    """
    own = [c for c in rows.columns if c not in probes.columns]
    p = probes.select(*[F.col(k) for k in key], F.col(at).cast("double").alias("__t"), F.lit(1).alias("__probe"), F.struct(*probes.columns).alias("__p"), F.lit(None).alias("__r"))
    r = rows.select(*[F.col(k) for k in key], centre.cast("double").alias("__t"), F.lit(0).alias("__probe"), F.lit(None).alias("__p"), F.struct(centre.cast("double").alias("c"), F.col(order).alias("o"), F.struct(*own).alias("v")).alias("__r"))
    line = Window.partitionBy(*key)
    before = F.max("__r").over(line.orderBy("__t", "__probe").rowsBetween(Window.unboundedPreceding, 0))
    same_centre = rows.groupBy(*key, centre.cast("double").alias("__t")).agg(F.min(order).alias(order))
    r = r.join(same_centre.select(*key, F.col("__t"), F.col(order).alias("__o")), [*key, "__t"]).where(F.col("__r.o") == F.col("__o")).select(*key, "__t", "__probe", "__p", "__r")
    both = p.select(*key, "__t", "__probe", "__p", F.col("__r").cast(r.schema["__r"].dataType)).unionByName(r.withColumn("__p", F.col("__p").cast(p.schema["__p"].dataType)))
    after = F.min("__r").over(line.orderBy("__t", F.col("__probe").desc()).rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("__b", before).withColumn("__a", after).where("__probe = 1")
    left, right = F.abs(F.col("__t") - F.col("__b.c")), F.abs(F.col("__t") - F.col("__a.c"))
    pick = F.when(F.col("__a").isNull(), F.col("__b")).when(F.col("__b").isNull(), F.col("__a")).when(left < right, F.col("__b")).when(right < left, F.col("__a"))
    pick = pick.otherwise(F.when(F.col("__b.o") <= F.col("__a.o"), F.col("__b")).otherwise(F.col("__a")))
    return found.withColumn("__x", pick).where(F.col("__x").isNotNull()).select("__p.*", *[F.col(f"__x.v.`{c}`").alias(c) for c in own])


def level_of(length: Column, base: float) -> Column:
    """The least l such that buckets of base * 2^l are no shorter than the length."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(base)) / base))).cast("int")


def own_buckets(spans: DataFrame, base: float) -> DataFrame:
    """Every span under the one or two buckets of its level (__l, __b) that it touches."""
    rows = spans.withColumn("__l", level_of(F.col("end") - F.col("start"), base)).withColumn("__z", base * F.pow(F.lit(2.0), F.col("__l")))
    return rows.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / F.col("__z")), F.floor(F.col("end") / F.col("__z")))))


def at_levels(rows: DataFrame, spans: DataFrame, base: float, first: Column) -> DataFrame:
    """Rows once for every level from ``first`` to the highest of the spans: adds __l and __z, the level's bucket size."""
    most = spans.agg(F.coalesce(F.max(level_of(F.col("end") - F.col("start"), base)), F.lit(0)).alias("__most"))
    leveled = rows.crossJoin(F.broadcast(most)).withColumn("__l", F.explode(F.sequence(first, F.greatest(first, F.col("__most")))))
    return leveled.withColumn("__z", base * F.pow(F.lit(2.0), F.col("__l"))).drop("__most")


def active_at(probes: DataFrame, spans: DataFrame, key: list[str], at: str, base: float) -> DataFrame:
    """Interval join: every span of the probe's key with start <= time <= end.

    Spans are listed in buckets of their own order of length, one or two each however long they are; a probe looks into one
    bucket per level. A busy key is dealt over its buckets.
    """
    listed = own_buckets(spans, base).drop("__z")
    asked = at_levels(probes, spans, base, F.lit(0)).withColumn("__b", F.floor(F.col(at) / F.col("__z"))).drop("__z")
    return asked.join(listed, [*key, "__l", "__b"]).where((F.col("start") <= F.col(at)) & (F.col(at) <= F.col("end"))).drop("__l", "__b")


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def overlapping_pairs(spans: DataFrame, key: list[str], id_: str, base: float) -> DataFrame:
    """Self-join: pairs a, b of spans of one key, a's id the lesser, that overlap (ends exclusive).

    Spans meet in buckets of the longer one's order of length, where both touch one or two, and the pair is kept in the
    first that both touch, so each comes once and a very long span costs no more rows than a short one.
    """
    cols = [c for c in spans.columns if c not in key]
    rows = spans.where("end > start")
    long = own_buckets(rows, base).select(*key, "__l", "__z", "__b", *[F.col(c).alias(f"y_{c}") for c in cols])
    short = at_levels(rows.withColumn("__own", level_of(F.col("end") - F.col("start"), base)), rows, base, F.col("__own"))
    short = short.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / F.col("__z")), F.floor(F.col("end") / F.col("__z")))))
    short = short.select(*key, "__l", "__b", "__own", *[F.col(c).alias(f"x_{c}") for c in cols])
    x, y = F.col(f"x_{id_}"), F.col(f"y_{id_}")
    met = short.join(long, [*key, "__l", "__b"]).where((F.col("x_start") < F.col("y_end")) & (F.col("y_start") < F.col("x_end")))
    met = met.where(((F.col("__own") < F.col("__l")) & (x != y)) | ((F.col("__own") == F.col("__l")) & (x < y)))
    met = met.where(F.col("__b") == F.greatest(F.floor(F.col("x_start") / F.col("__z")), F.floor(F.col("y_start") / F.col("__z"))))
    pick = lambda c, first: F.when(x < y, F.col(f"{'x' if first else 'y'}_{c}")).otherwise(F.col(f"{'y' if first else 'x'}_{c}"))
    return met.select(*key, *[pick(c, True).alias(f"a_{c}") for c in cols], *[pick(c, False).alias(f"b_{c}") for c in cols])


def dedupe_utterances(df: DataFrame, key: list[str], order: list[str], gap: float = 1.5, carry: list[str] | None = None) -> DataFrame:
    """Drops a row whose text is that of the last kept row if it starts within ``gap`` of that one's end, which it extends.

    df: key, start, end, text and the ``order`` columns. Rows with equal neighbours form islands; the fold runs within one.
    ``carry`` names further columns that a kept row brings along.
    """
    line = Window.partitionBy(*key).orderBy(*order)
    cut = F.lag("text").over(line).isNull() | (F.lag("text").over(line) != F.col("text"))
    islands = df.withColumn("__g", F.sum(cut.cast("int")).over(line))
    carry = carry or []
    more = [F.col(c).alias(f"__{c}") for c in carry]
    listed = islands.groupBy(*key, "__g", "text").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("start").alias("__s"), F.col("end").alias("__e"), *more))).alias("rows"))
    kinds = "".join(f",{c}:{df.schema[c].dataType.simpleString()}" for c in carry)
    empty = F.array().cast(f"array<struct<start:double,end:double{kinds}>>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        near = (F.size(a) > 0) & (x["__s"] - F.when(F.size(a) > 0, last["end"]) < gap)
        kept = [last[c].alias(c) for c in carry]
        longer = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["__e"]).alias("end"), *kept)))
        new = F.struct(x["__s"].alias("start"), x["__e"].alias("end"), *[x[f"__{c}"].alias(c) for c in carry])
        return F.when(near, longer).otherwise(F.concat(a, F.array(new)))

    return listed.select(*key, "text", F.explode(F.aggregate("rows", empty, step)).alias("r")).select(*key, "text", "r.*")
