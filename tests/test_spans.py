import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import spans as sp


def series(spark, values, video="v"):
    return spark.createDataFrame([(video, i, float(i), float(i + 1), float(x)) for i, x in enumerate(values)], "video string, w long, t0 double, t1 double, score double")


@pytest.mark.parametrize(
    "values,width,expected",
    [
        ([0.1, 0.1, 0.9, 0.1, 0.1], 3, [0.1] * 5),
        ([0.1, 0.9, 0.9, 0.9, 0.1], 3, [0.1, 0.9, 0.9, 0.9, 0.1]),
        ([0.8] * 7, 3, [0.8] * 7),
        ([0.5, 0.2], 5, [0.5, 0.2]),
        ([0.3, 0.1, 0.2], 9, [0.3, 0.2, 0.2]),
        ([0.3, 0.1, 0.2], 1, [0.3, 0.1, 0.2]),
    ],
)
def test_median_literals(spark, values, width, expected):
    out = sp.median_smooth(series(spark, values), ["video"], "w", "score", width).orderBy("w").collect()
    assert [r.smooth for r in out] == expected


def scalar_median(values, width):
    if width <= 1 or len(values) < 3:
        return values
    width = min(width, len(values))
    width += width % 2 == 0
    half = width // 2
    line = [values[0]] * half + values + [values[-1]] * half
    return [sorted(line[i : i + width])[half] for i in range(len(values))]


def test_median_against_scalar(spark):
    r = random.Random(1)
    lines = {f"v{i}": [round(r.random(), 3) for _ in range(r.randrange(1, 12))] for i in range(25)}
    df = None
    for k, v in lines.items():
        part = series(spark, v, k)
        df = part if df is None else df.union(part)
    for width in (3, 4, 5, 8):
        got = {}
        for x in sp.median_smooth(df, ["video"], "w", "score", width).orderBy("video", "w").collect():
            got.setdefault(x.video, []).append(x.smooth)
        assert got == {k: scalar_median(v, width) for k, v in lines.items()}


def spans(spark, mask, scores=None, gap=0.0, least=0.0):
    rows = [("v", i, float(i), float(i + 1), float((scores or mask)[i]), bool(m)) for i, m in enumerate(mask)]
    df = spark.createDataFrame(rows, "video string, w long, t0 double, t1 double, score double, mask boolean")
    return [tuple(r)[1:] for r in sp.spans_from_mask(df, ["video"], "w", "mask", gap, least).orderBy("start").collect()]


def test_span_literals(spark):
    assert spans(spark, [0, 1, 1, 1, 0], [0.1, 0.8, 0.9, 0.7, 0.1]) == [(1.0, 4.0, pytest.approx(0.8), 0.9)]
    assert [s[:2] for s in spans(spark, [1, 0, 0, 1])] == [(0.0, 1.0), (3.0, 4.0)]
    assert [s[:2] for s in spans(spark, [1, 0, 1], gap=1.5)] == [(0.0, 3.0)]
    assert len(spans(spark, [1, 0, 0, 0, 1], gap=0.5)) == 2
    assert len(spans(spark, [1, 0, 1, 1, 1], least=1.5)) == 1
    assert spans(spark, [0, 1, 1])[0][1] == 3.0
    assert spans(spark, [1, 1, 0, 1], [1, 1, 0, 0], gap=1.5)[0][2] == pytest.approx(2 / 3)
    assert spans(spark, [0, 0]) == []


def test_merge_against_scalar(spark):
    r = random.Random(4)
    for gap in (0.25, 1.2, 3.0):
        mask = [r.random() < 0.4 for _ in range(60)]
        scores = [r.random() for _ in mask]
        want = []
        for a, b, s, p in spans(spark, mask, scores):
            if want and a - want[-1][1] <= gap:
                held, new = want[-1][1] - want[-1][0], b - a
                want[-1] = [want[-1][0], b, (want[-1][2] * held + s * new) / (held + new), max(want[-1][3], p)]
            else:
                want.append([a, b, s, p])
        assert spans(spark, mask, scores, gap) == [(a, b, pytest.approx(s), p) for a, b, s, p in want]


@pytest.mark.parametrize("n,span,hop,expected", [(100, 32, 16, [0, 16, 32, 48, 64, 68]), (10, 32, 16, [0]), (96, 32, 32, [0, 32, 64]), (5, 0, 0, [0, 1, 2, 3, 4])])
def test_window_starts(spark, n, span, hop, expected):
    assert spark.range(1).select(sp.window_starts(F.lit(n), F.lit(span), F.lit(hop)).alias("s")).first().s == expected


def test_sample_indices(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(sp.sample_indices(F.lit(100), 4, 2)) == [47, 49, 51, 53]
    assert one(sp.sample_indices(F.lit(3), 4)) == [0, 1, 1, 2]
    assert one(sp.sample_indices(F.lit(10), 4, 2, "contiguous")) == [1, 3, 5, 7]
    assert one(sp.sample_indices(F.lit(2), 4, 1, "contiguous", F.lit(0))) == [0, 1, 1, 1]


def test_energy_events(spark):
    def events(line):
        df = spark.createDataFrame([("v", i, float(x)) for i, x in enumerate(line)], "video string, i long, e double")
        return [(r.start, r.end) for r in sp.energy_events(df, ["video"], "i", "e", 0.01).orderBy("start").collect()]

    quiet = [-60.0] * 100
    burst = quiet[:30] + [-10.0] * 10 + quiet[:60]
    assert events(burst) == [(pytest.approx(0.3), pytest.approx(0.4))]
    assert events([x - 20 for x in burst]) == events(burst)
    assert len(events(quiet[:20] + [-10.0] * 10 + quiet[:50] + [-10.0] * 10 + quiet[:10])) == 2
    assert len(events(quiet[:20] + [-10.0] * 10 + quiet[:2] + [-10.0] * 10 + quiet[:50])) == 1
    assert events(quiet) == [] and events(quiet + [-10.0] + quiet) == []


def test_overlaps_and_active_against_brute_force(spark):
    r = random.Random(3)
    rows = [("v" if r.random() < 0.8 else "u", i, a, a + r.choice([0.0, 0.5, 3.0, 40.0, 5000.0]) * r.random()) for i, a in enumerate([r.uniform(-50, 500) for _ in range(120)])]
    df = spark.createDataFrame(rows, "video string, id long, start double, end double")
    got = sorted((p.a_id, p.b_id) for p in sp.overlapping_pairs(df, ["video"], "id", 1.0).collect())
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3] and a[3] > a[2] and b[3] > b[2])
    assert got == want
    probes = spark.createDataFrame([("v", float(t)) for t in range(-60, 600, 7)], "video string, t double")
    found = sorted((p.t, p.id) for p in sp.active_at(probes, df, ["video"], "t", 1.0).collect())
    assert found == sorted((float(t), x[1]) for t in range(-60, 600, 7) for x in rows if x[0] == "v" and x[2] <= t <= x[3])


def test_nearest_first_of_equals(spark):
    rows = spark.createDataFrame([("v", 1, 0.0), ("v", 2, 2.0), ("v", 3, 2.0), ("u", 4, 9.0)], "video string, id long, c double")
    probes = spark.createDataFrame([("v", 1.0), ("v", 1.9), ("v", -5.0), ("v", 99.0), ("w", 1.0)], "video string, t double")
    out = {r.t: r.id for r in sp.nearest(probes, rows, ["video"], "t", F.col("c"), "id").collect()}
    assert out == {1.0: 1, 1.9: 2, -5.0: 1, 99.0: 2}


def test_dedupe_extends_the_kept_row(spark):
    rows = [("c", 0, "a", 0.0, 1.0), ("c", 1, "a", 2.0, 3.0), ("c", 2, "a", 9.0, 10.0), ("c", 3, "b", 10.0, 11.0), ("c", 4, "a", 10.5, 12.0)]
    df = spark.createDataFrame(rows, "k string, i long, text string, start double, end double")
    out = sorted((r.text, r.start, r.end) for r in sp.dedupe_utterances(df, ["k"], ["i"]).collect())
    assert out == [("a", 0.0, 3.0), ("a", 9.0, 10.0), ("a", 10.5, 12.0), ("b", 10.0, 11.0)]
