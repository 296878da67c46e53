import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import longline, spans as sp


@pytest.fixture(scope="module")
def line(spark):
    r = random.Random(8)
    rows = []
    for video, n in {"a": 300, "b": 40, "c": 3, "d": 1}.items():
        t = 0.0
        for i in range(n):
            t += r.choice([0.1, 0.5, 0.5, 3.0])
            rows.append((video, i, round(t, 3), round(t + r.choice([0.2, 1.0]), 3), round(r.random(), 3), r.random() < 0.6))
    return spark.createDataFrame(rows, "video string, w long, t0 double, t1 double, score double, mask boolean").repartition(3)


def same(a, b):
    assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def rounded(df):
    return df.withColumn("score", F.round("score", 9))


def test_primitives(line):
    v = ["video"]
    whole = sp.Window.partitionBy("video").orderBy("w")
    same(longline.row_index(line, v, ["w"], 7, "x"), line.withColumn("x", F.row_number().over(whole)))
    same(longline.previous(line, v, ["w"], 7, "score", "x"), line.withColumn("x", F.lag("score").over(whole)))
    marked = F.when(F.col("score") > 0.9, F.col("score"))
    same(longline.carried(line, v, ["w"], 3, marked, "x"), line.withColumn("x", F.last(marked, True).over(whole.rowsBetween(sp.Window.unboundedPreceding, 0))))


def test_buckets_change_nothing(line):
    v = ["video"]
    for gap in (0.0, 0.6, 5.0):
        same(rounded(sp.spans_from_mask(line, v, "w", "mask", gap, bucket=11, span_bucket=9.0)), rounded(sp.spans_from_mask(line, v, "w", "mask", gap)))
    same(sp.hysteresis(line, v, "w", "score", F.lit(0.8), F.lit(0.3), bucket=5), sp.hysteresis(line, v, "w", "score", F.lit(0.8), F.lit(0.3)))
    events = line.select("video", F.col("t0").alias("start"), F.col("t1").alias("end"))
    same(sp.merge_gaps(events, v, 0.2, bucket=4.0), sp.merge_gaps(events, v, 0.2))
    masked = line.where("mask")
    same(sp.frame_runs(masked, v, "w", bucket=6), sp.frame_runs(masked, v, "w"))
    same(sp.local_rate(line, v, "t0", 2.0, bucket=3.0), sp.local_rate(line, v, "t0", 2.0))
    for width in (2, 3, 7):
        same(sp._median_in_stretches(line, v, "w", "score", width, "smooth", 13, stretch=8), sp.median_smooth(line, v, "w", "score", width))
        same(sp.median_smooth(line, v, "w", "score", width, bucket=13), sp.median_smooth(line, v, "w", "score", width))
