"""Queries on spans and score windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import rules, spans as sp
from spanloom.plans.bindings import SPANS, TOTALS, WINDOWS, micros, spans, table, totals, windows
from spanloom.plans.registry import register
from spanloom.schema import AROUSAL_FLAGS

FLAGS = ", ".join(f"'{x}'" for x in AROUSAL_FLAGS)


@register(
    "time_per_behaviour",
    f"""WITH {SPANS} SELECT video, behaviour, CAST(sum(CAST("end" - start AS DECIMAL(18,6))) AS DOUBLE) AS seconds FROM ev GROUP BY ALL""",
)
def time_per_behaviour(spark, sf_dir):
    rows = spans(spark, sf_dir).groupBy("video", "behaviour").agg(F.sum(rules.duration().cast("decimal(18,6)")).cast("double").alias("seconds"))
    return rows


@register(
    "dominant_behaviour",
    f"""WITH {SPANS}, t AS (SELECT video, behaviour, sum(CAST("end" - start AS DECIMAL(18,6))) AS s FROM ev GROUP BY ALL)
    SELECT video, behaviour, CAST(s AS DOUBLE) AS seconds FROM t QUALIFY row_number() OVER (PARTITION BY video ORDER BY s DESC, behaviour) = 1""",
)
def dominant_behaviour(spark, sf_dir):
    return rules.dominant(time_per_behaviour(spark, sf_dir), ["video"])


@register(
    "arousal_fraction",
    f"""WITH {SPANS}, {TOTALS}, f AS (SELECT video, sum("end" - start) AS s FROM ev WHERE behaviour IN ({FLAGS}) GROUP BY video)
    SELECT video, round(CASE WHEN duration > 0 THEN least(1e0, coalesce(s, 0e0) / duration) ELSE 0e0 END, 9) AS arousal_fraction FROM tot LEFT JOIN f USING (video)""",
)
def arousal_fraction(spark, sf_dir):
    out = rules.arousal_fraction(spans(spark, sf_dir), totals(spark, sf_dir), ["video"], AROUSAL_FLAGS)
    return out.withColumn("arousal_fraction", F.round("arousal_fraction", 9))


@register(
    "sliding_window_starts",
    """WITH u AS (SELECT user_id AS video, count(*) AS n FROM events GROUP BY user_id),
    s AS (SELECT video, n, unnest(CASE WHEN n <= 16 THEN [0] ELSE list_distinct(list_concat(range(0, n - 16 + 1, 7), [n - 16])) END) AS start FROM u)
    SELECT video, CAST(start AS BIGINT) AS start, CAST(least(n, start + 16) AS BIGINT) AS stop FROM s""",
)
def sliding_window_starts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n"))
    starts = rows.withColumn("start", F.explode(sp.window_starts(F.col("n"), F.lit(16), F.lit(7))))
    return starts.select("video", "start", F.least("n", F.col("start") + 16).alias("stop"))


@register(
    "sample_indices_tsn",
    """WITH u AS (SELECT user_id AS video, count(*) AS n FROM events GROUP BY user_id),
    k AS (SELECT video, n, least(24, n) AS w, CASE WHEN n > least(24, n) THEN (n - least(24, n)) // 2 ELSE 0 END AS b, unnest(range(0, 12)) AS k FROM u)
    SELECT video, CAST(k AS BIGINT) AS k, CAST(greatest(0, least(n - 1, floor(b + (k + 0.5e0) * w / 12e0))) AS BIGINT) AS frame FROM k""",
)
def sample_indices_tsn(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n"))
    return rows.select("video", F.posexplode(sp.sample_indices(F.col("n"), 12, 2)).alias("k", "frame")).select("video", F.col("k").cast("long").alias("k"), "frame")


@register(
    "span_frames",
    f"""WITH {SPANS}, f AS (SELECT id, start, greatest(0, floor(start * 0.01e0)) AS a, least(20000 - 1, ceil("end" * 0.01e0) - 1) AS b FROM ev)
    SELECT id, CAST(CASE WHEN b < a THEN least(19999, a) ELSE a END AS BIGINT) AS first, CAST(CASE WHEN b < a THEN least(19999, a) ELSE b END AS BIGINT) AS last FROM f""",
)
def span_frames(spark, sf_dir):
    rows = spans(spark, sf_dir).select("id", sp.frame_range(F.col("start"), F.col("end"), F.lit(0.01), F.lit(20000)).alias("r"))
    return rows.select("id", "r.first", "r.last")


def _median(width: int) -> str:
    h = width // 2
    near = ", ".join(
        f"coalesce(lag(score, {-k}) OVER o, first_value(score) OVER p)" if k < 0 else f"coalesce(lead(score, {k}) OVER o, last_value(score) OVER p)" if k else "score" for k in range(-h, h + 1)
    )
    return f"""WITH {WINDOWS} SELECT video, w, round(list_sort([{near}])[{h + 1}], 9) AS smooth FROM wi
    WINDOW o AS (PARTITION BY video ORDER BY w), p AS (PARTITION BY video ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@register("median_smooth_w3", _median(3))
def median_smooth_w3(spark, sf_dir):
    return sp.median_smooth(windows(spark, sf_dir), ["video"], "w", "score", 3).select("video", "w", F.round("smooth", 9).alias("smooth"))


@register("median_smooth_w5", _median(5))
def median_smooth_w5(spark, sf_dir):
    return sp.median_smooth(windows(spark, sf_dir), ["video"], "w", "score", 5).select("video", "w", F.round("smooth", 9).alias("smooth"))


RUNS = f"""{WINDOWS}, g AS (SELECT *, w - row_number() OVER (PARTITION BY video ORDER BY w) AS g FROM wi WHERE mask),
ru AS (SELECT video, min(t0) AS start, max(t1) AS "end", avg(score) AS score, max(score) AS peak FROM g GROUP BY video, g)"""
MERGED = f"""{RUNS}, c AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY video ORDER BY start) <= 0.25e0 THEN 0 ELSE 1 END AS cut FROM ru),
i AS (SELECT *, sum(cut) OVER (PARTITION BY video ORDER BY start) AS k FROM c),
l AS (SELECT video, k, list({{'s': start, 'e': "end", 'q': score, 'p': peak}} ORDER BY start) AS x FROM i GROUP BY video, k),
m AS (SELECT video, list_reduce(x, lambda a, b: {{'s': a.s, 'e': b.e, 'q': (a.q * (a.e - a.s) + b.q * (b.e - b.s)) / ((a.e - a.s) + (b.e - b.s)), 'p': greatest(a.p, b.p)}}) AS r FROM l),
me AS (SELECT video, r.s AS start, r.e AS "end", round(r.q, 9) AS score, round(r.p, 9) AS peak FROM m)"""


def rounded(df):
    return df.withColumn("score", F.round("score", 9)).withColumn("peak", F.round("peak", 9))


@register("spans_from_mask", f"""WITH {RUNS} SELECT video, start, "end", round(score, 9) AS score, round(peak, 9) AS peak FROM ru""")
def spans_from_mask(spark, sf_dir):
    return rounded(sp.spans_from_mask(windows(spark, sf_dir), ["video"], "w", "mask"))


@register("spans_merged", f"WITH {MERGED} SELECT * FROM me")
def spans_merged(spark, sf_dir):
    return rounded(sp.spans_from_mask(windows(spark, sf_dir), ["video"], "w", "mask", merge_gap=0.25))


@register("spans_min_duration", f"""WITH {MERGED} SELECT * FROM me WHERE "end" - start >= 3""")
def spans_min_duration(spark, sf_dir):
    return rounded(sp.spans_from_mask(windows(spark, sf_dir), ["video"], "w", "mask", merge_gap=0.25, min_duration=3.0))


@register(
    "hysteresis_events",
    f"""WITH {WINDOWS}, s AS (SELECT video, w, coalesce(last_value(CASE WHEN value >= 80 THEN true WHEN value < 30 THEN false END IGNORE NULLS)
      OVER (PARTITION BY video ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS active FROM wi),
    g AS (SELECT video, w, w - row_number() OVER (PARTITION BY video ORDER BY w) AS g FROM s WHERE active)
    SELECT video, CAST(min(w) AS BIGINT) AS first, CAST(max(w) AS BIGINT) AS last FROM g GROUP BY video, g""",
)
def hysteresis_events(spark, sf_dir):
    rows = sp.hysteresis(windows(spark, sf_dir), ["video"], "w", "value", F.lit(80.0), F.lit(30.0)).where("active")
    return sp.frame_runs(rows, ["video"], "w").select("video", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@register(
    "energy_events",
    f"""WITH {WINDOWS}, l AS (SELECT video, quantile_cont(value, 0.2e0) AS lo, quantile_cont(value, 0.99e0) AS hi FROM wi GROUP BY video),
    v AS (SELECT video, lo + 9e0 * least(1e0, (hi - lo) / 25e0) AS op, lo + 5e0 * least(1e0, (hi - lo) / 25e0) AS cl FROM l WHERE hi - lo >= 3),
    s AS (SELECT video, w, coalesce(last_value(CASE WHEN value >= op THEN true WHEN value < cl THEN false END IGNORE NULLS)
      OVER (PARTITION BY video ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS active FROM wi JOIN v USING (video)),
    g AS (SELECT video, w, w - row_number() OVER (PARTITION BY video ORDER BY w) AS g FROM s WHERE active),
    f AS (SELECT video, min(w) * 0.25e0 AS start, (max(w) + 1) * 0.25e0 AS "end" FROM g GROUP BY video, g),
    c AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY video ORDER BY start) <= 0.25e0 THEN 0 ELSE 1 END AS cut FROM f),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY video ORDER BY start) AS k FROM c),
    m AS (SELECT video, min(start) AS start, max("end") AS "end" FROM i GROUP BY video, k)
    SELECT video, start, least("end", start + 4e0) AS "end" FROM m WHERE "end" - start >= 0.5e0""",
)
def energy_events(spark, sf_dir):
    return sp.energy_events(windows(spark, sf_dir), ["video"], "w", "value", 0.25, gap=0.25, least=0.5)


@register(
    "local_rate",
    f"""WITH {SPANS} SELECT video, id, count(*) OVER (PARTITION BY video ORDER BY start RANGE BETWEEN 36000e0 PRECEDING AND 36000e0 FOLLOWING) - 1 AS rate FROM ev""",
)
def local_rate(spark, sf_dir):
    return sp.local_rate(spans(spark, sf_dir), ["video"], "start", 36000.0).select("video", "id", "rate")


@register(
    "nearest_window",
    f"""WITH {SPANS}, pr AS (SELECT user_id AS video, p, p * 86400e0 AS t FROM (SELECT DISTINCT user_id FROM events), range(0, 30) r(p)),
    j AS (SELECT pr.video, p, id, abs((start + "end") / 2e0 - t) AS d, row_number() OVER (PARTITION BY pr.video, p ORDER BY abs((start + "end") / 2e0 - t), id) AS n FROM pr JOIN ev ON pr.video = ev.video)
    SELECT video, CAST(p AS BIGINT) AS p, id FROM j WHERE n = 1""",
)
def nearest_window(spark, sf_dir):
    rows = spans(spark, sf_dir)
    probes = rows.select("video").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(29)).cast("array<bigint>"))).withColumn("t", F.col("p") * 86400.0)
    return sp.nearest(probes, rows.select("video", "id", "start", "end"), ["video"], "t", (F.col("start") + F.col("end")) / 2.0, "id").select("video", "p", "id")


@register(
    "active_spans_topk",
    f"""WITH {SPANS}, pr AS (SELECT user_id AS video, p, p * 21600e0 AS t FROM (SELECT DISTINCT user_id FROM events), range(0, 120) r(p)),
    j AS (SELECT pr.video, p, id, row_number() OVER (PARTITION BY pr.video, p ORDER BY score DESC, id) AS rank FROM pr JOIN ev ON pr.video = ev.video AND t BETWEEN start AND "end")
    SELECT video, CAST(p AS BIGINT) AS p, id, CAST(rank AS INT) AS rank FROM j WHERE rank <= 4""",
)
def active_spans_topk(spark, sf_dir):
    rows = spans(spark, sf_dir)
    probes = rows.select("video").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(119)).cast("array<bigint>"))).withColumn("t", F.col("p") * 21600.0)
    found = sp.active_at(probes, rows, ["video"], "t", 21600.0)
    return sp.top_k(found, ["video", "p"], [F.col("score").desc(), F.col("id")], 4).select("video", "p", "id", "rank")


@register(
    "overlapping_pairs",
    f"""WITH {SPANS} SELECT a.video, a.id AS a_id, b.id AS b_id FROM ev a JOIN ev b ON a.video = b.video AND a.id < b.id AND a.start < b."end" AND b.start < a."end" """,
)
def overlapping_pairs(spark, sf_dir):
    return sp.overlapping_pairs(spans(spark, sf_dir).select("video", "id", "start", "end"), ["video"], "id", 3600.0).select("video", "a_id", "b_id")


@register(
    "frame_runs",
    """WITH d AS (SELECT DISTINCT user_id AS video, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS frame FROM events),
    c AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) <= 1 THEN 0 ELSE 1 END AS cut FROM d),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY video ORDER BY frame) AS g FROM c)
    SELECT video, min(frame) AS first, max(frame) AS last FROM g GROUP BY video, g""",
)
def frame_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.floor(micros("ts") / 3600000000).alias("frame"))
    return sp.frame_runs(rows, ["video"], "frame")


@register(
    "top_behaviours",
    f"""WITH {SPANS}, t AS (SELECT behaviour, id, score, row_number() OVER (PARTITION BY behaviour ORDER BY score DESC, id) AS rank FROM ev)
    SELECT behaviour, id, CAST(rank AS INT) AS rank FROM t WHERE rank <= 5""",
)
def top_behaviours(spark, sf_dir):
    return sp.top_k(spans(spark, sf_dir), ["behaviour"], [F.col("score").desc(), F.col("id")], 5).select("behaviour", "id", "rank")


@register(
    "utterance_dedupe",
    """WITH u AS (SELECT conv_id, turn, role AS text, CAST(turn AS DOUBLE) AS start, turn + 0.6e0 AS "end" FROM conversations),
    p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, lag("end") OVER (PARTITION BY conv_id ORDER BY turn) AS pe FROM u),
    c AS (SELECT *, CASE WHEN prev = text AND start - pe < 1.5e0 THEN 0 ELSE 1 END AS cut FROM p),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM c)
    SELECT conv_id, text, min(start) AS start, max("end") AS "end" FROM g GROUP BY conv_id, g, text""",
)
def utterance_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("text"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 0.6).alias("end"))
    return sp.dedupe_utterances(rows, ["conv_id"], ["turn"])
