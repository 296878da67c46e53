import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.operators import audit, dedup, rules, splits, text
from spanloom.schema import affect_dim, label_dim, voice_dim


def brute_classes(words, distance, bits):
    far = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
    linked = {a: [b for b in words if b != a and far(words[a], words[b]) <= distance] for a in words}
    least = {a: a for a in words}
    for _ in words:
        for a, others in linked.items():
            least[a] = min([least[a], *(least[b] for b in others)])
    return sorted((a, least[a], len(linked[a])) for a in words)


def test_hamming_classes(spark):
    rows = [("a", [0, 0]), ("b", [0, 15]), ("c", [0, 0]), ("d", [-1, -1])]
    df = spark.createDataFrame(rows, "k string, w array<long>")
    for d in (0, 3, 4):
        assert sorted(map(tuple, dedup.near_classes(df, "k", "w", 128, d).collect())) == brute_classes(dict(rows), d, 128)
    assert dedup.near_classes(df.limit(0), "k", "w", 128, 3).count() == 0


def test_banded_join_is_lossless(spark, monkeypatch):
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(12)]
    words = {i: base[i % 12] ^ sum(1 << r.randrange(63) for _ in range(r.randrange(5))) for i in range(90)}
    words = {i: (w & (1 << 63) - 1) << 1 for i, w in words.items()}
    words = {i: [w - (1 << 64) if w >= 1 << 63 else w] for i, w in words.items()}
    df = spark.createDataFrame(list(words.items()), "k long, w array<long>")
    for d, block, batch in ((2, 1024, 20_000), (6, 1024, 20_000), (6, 3, 50)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "BATCH", batch)
        assert sorted(map(tuple, dedup.near_classes(df, "k", "w", 63, d).collect())) == brute_classes(words, d, 63)


def test_merge_groups_takes_the_least(spark):
    rows = [("g3", 1, [0]), ("g1", 2, [1]), ("g2", 3, [3]), ("g9", 4, [-1]), ("g9", 0, [255 << 20]), ("g8", 5, None)]
    df = spark.createDataFrame(rows, "g string, o int, w array<long>")
    out = {r.group: r.canonical for r in dedup.merge_duplicate_groups(df, "g", "o", "w", 64, 1).collect()}
    assert out == {"g1": "g1", "g2": "g1", "g3": "g1", "g9": "g9", "g8": "g8"}


def test_splits(spark):
    r = random.Random(3)
    rows = [(f"g{i % 20}", ["common"] if i % 20 else ["rare"]) for i in range(60)] + [(f"h{i}", [r.choice(["common", "rare"])] if i % 5 else []) for i in range(200)]
    df = spark.createDataFrame(rows, "grp string, labels array<string>")
    for fractions in ({"train": 0.7, "val": 0.3}, {"train": 70, "val": 20, "test": 10}):
        out = {r.group: r.split for r in splits.make_splits(df, "grp", "labels", fractions, 1).collect()}
        assert set(out) == {g for g, _ in rows} and set(out.values()) == set(fractions)
        share = sum(out[g] == "train" for g, _ in rows) / len(rows)
        assert 0.6 < share < 0.8
        for name in ("rare", "common"):
            assert {out[g] for g, x in rows if name in x} == set(fractions)
        assert out == {r.group: r.split for r in splits.make_splits(df.repartition(7), "grp", "labels", fractions, 1).collect()}
    with pytest.raises(ValueError):
        splits.make_splits(df, "grp", "labels", {"a": 0.0})


def test_samplers(spark):
    df = spark.createDataFrame([(i, ["a"] if i else ["a", "b"]) for i in range(400)] + [(400, [])], "id long, labels array<string>")
    factors = splits.repeat_factors(df, "id", "labels")
    got = {r.id: r.factor for r in factors.collect()}
    assert got[0] == pytest.approx((0.05 * 401) ** 0.5) and got[1] == 1.0 and got[400] == 1.0
    copies = Counter(r.id for r in splits.draw_repeats(factors, 1).collect())
    assert copies[0] in (4, 5) and all(copies[i] == 1 for i in range(1, 401))
    weights = {r.id: r.weight for r in splits.class_balanced_weights(df, "id", "labels").collect()}
    total = (1 / 400 + 1) / 2 + 399 / 400 + 1
    assert weights[0] == pytest.approx((1 / 400 + 1) / 2 / total) and sum(weights.values()) == pytest.approx(1)
    drawn = Counter(r.id for r in splits.draw_weighted(splits.class_balanced_weights(df, "id", "labels"), 4000, 2).collect())
    assert sum(drawn.values()) == 4000 and 1400 < drawn[400] < 2200


def test_audit_codes(spark):
    media = spark.createDataFrame([("v", 10.0, 25.0, 640, 480), ("w", 10.0, 5.0, 100, 480)], "video string, duration double, fps double, width int, height int")
    rows = [
        (1, "v", ["sitting"], 0.0, 5.0, "v"), (2, "v", ["running"], 4.0, 8.0, "v"), (3, "gone", ["sitting"], 0.0, None, "g"), (4, "v", ["tail_wag"], 1.0, 3.0, "v"), (5, "v", [], 3.0, 1.0, "v"),
        (6, "v", ["sitting"], 9999.0, None, "v"), (7, "v", ["playing"], 1.0, 9999.0, "v"), (8, "v", ["playing"], 1.0, 1.5, "v"), (9, "w", ["sitting"], 0.0, None, "w"), (10, "v", ["sitting"], -1.0, 2.0, "v"),
    ]
    df = spark.createDataFrame(rows, "id long, video string, labels array<string>, start double, end double, group string")
    labels = label_dim(spark, ["sitting", "running", "playing", "tail_wagging"])
    found = Counter(r.code for r in audit.audit_annotations(df, media, labels).collect())
    assert found == Counter(missing_file=1, negative=1, bad_span=3, span_overrun=1, span_too_short=1, low_fps=1, low_resolution=1, contradiction=1, unknown_label=1, no_examples=1, few_examples=3)
    hint = [r.message for r in audit.audit_annotations(df, media, labels).where("code = 'unknown_label'").collect()]
    assert hint == ["tail_wag: did you mean tail_wagging?"]
    assert {r.code for r in audit.audit_annotations(df.where("false"), media).collect()} == {"empty"}


def read(spark, rows, seconds, known=None):
    spans = spark.createDataFrame([("v", *r) for r in rows], "video string, behaviour string, start double, end double, score double")
    return rules.read_affect(spans, affect_dim(spark), spark.createDataFrame([("v", float(seconds))], "video string, duration double"), ["video"], known).first()


def test_affect(spark):
    none = read(spark, [], 10)
    assert (none.label, none.confidence, none.valence) == ("not enough to say", 0.0, 0.0)
    play = read(spark, [("playing", 0.0, 9.0, 0.9)], 10)
    assert play.valence > 0.5 and play.arousal > 0.6 and "excited" in play.label and play.confidence == pytest.approx(0.7)
    tense = read(spark, [("alert_freeze", 0.0, 4.0, 0.9), ("barking", 2.0, 6.0, 0.8)], 8)
    assert tense.valence < -0.2 and tense.stress == ["alert_freeze", "barking"]
    assert read(spark, [("playing", 0.0, 0.5, 0.9)], 30).label == "not enough to say"


def test_blend_disagreement(spark):
    row = [("v", 0.8, 0.7, 0.9, -0.85, 0.9, 0.4, 0.9), ("w", 0.8, 0.7, 0.9, 0.0, 0.0, 0.0, None)]
    cols = "video string, affect_valence double, affect_arousal double, affect_confidence double, audio_valence double, audio_arousal double, audio_confidence double, urgent_arousal double"
    out = {r.video: r for r in rules.blend(spark.createDataFrame(row, cols)).collect()}
    assert out["v"].disagree and out["v"].valence <= 0.15 and out["v"].arousal == 0.9
    assert not out["w"].disagree and out["w"].valence == pytest.approx(0.8) and out["w"].confidence == pytest.approx(0.9 / 2.2)


def test_voice_rules(spark):
    cols = "seconds double, f0 double, periodicity double, flatness double, centroid double, loudness double, modulation double, formant double, high double, rate double"
    rows = [(0.1, 900, 0.6, 0.1, 2000, -20, 0, 0, 0, 0), (1.0, 150, 0.5, 0.3, 500, -20, 0, 0.3, 0, 0), (0.3, 500, 0.3, 0.4, 900, -20, 0, 0, 0, 4), (1.0, 120, 0.9, 0.05, 500, -50, 0.2, 0.8, 0, 0)]
    out = rules.voice_kind(spark.createDataFrame([tuple(map(float, r)) for r in rows], cols), voice_dim(spark)).orderBy("seconds", "f0").collect()
    assert [(r.kind, r.concerning) for r in out] == [("yelp", True), ("bark_alarm", True), ("speech", False), ("growl", True)]
    assert out[1].arousal == pytest.approx(0.9) and out[2].confidence == pytest.approx(0.6)


def test_enrich(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["x"]), ("c", ["barking"]), ("d", []), ("e", ["x"])], "video string, labels array<string>")
    audio = spark.createDataFrame([("a", {"bark": 2}, 0.9), ("b", {"whine": 3}, 0.9), ("c", {"bark": 1}, 0.9), ("e", {"bark": 2}, 0.1)], "video string, kinds map<string,int>, confidence double")
    out = {r.video: (r.status, r.labels) for r in rules.enrich(df, audio, "video", "barking", ["bark", "bark_alarm"], 1, 0.5).collect()}
    assert out["a"] == ("added", ["x", "barking"]) and out["b"] == ("no_audio_signal", ["x"]) and out["c"] == ("already_labelled", ["barking"])
    assert out["d"] == ("skipped_missing_audio", []) and out["e"][0] == "no_audio_signal"


def test_state_keys(spark):
    one = lambda *a: spark.range(1).select(rules.state_keys(*map(F.lit, a)).alias("k")).first().k
    assert one("playing", "growl", 0.7, -0.3) == ["growl", "playing", "negative_high", "default"]
    assert one("sitting", "", 0.2, 0.0) == ["sitting", "neutral", "default"]


def test_text(spark):
    same = spark.createDataFrame([("Same.",)] * 5, "t string")
    row = text.corpus_stats(same, "t").first()
    assert (row.n, row.distinct, row.distinct_ratio, row.mean_words) == (5, 1, 0.2, 1.0)
    assert text.corpus_stats(same.where("false"), "t").first().n == 0
    vocab = text.vocabulary(spark.createDataFrame([("A dog's walk, a walk.",)], "t string"), "t")
    assert {r.token: r.id for r in vocab.collect()} == {"<pad>": 0, "<bos>": 1, "<eos>": 2, "<unk>": 3, ",": 4, ".": 5, "a": 6, "dog's": 7, "walk": 8}
    docs = spark.createDataFrame([(1, "a cat walk"), (2, ""), (3, None)], "id long, t string")
    assert {r.id: r.ids for r in text.encode(docs, "id", "t", vocab).collect()} == {1: [1, 6, 3, 8, 2], 2: [1, 2], 3: [1, 2]}
    words = F.array(*map(F.lit, ["<bos>", "the", "dog", "sits", ",", "still", ".", "<eos>"]))
    assert spark.range(1).select(text.decode(words).alias("s")).first().s == "The dog sits, still."
    ood = {r.id: (r.ratio, r.uncertain) for r in text.out_of_domain(docs, "id", "t", vocab).collect()}
    assert ood == {1: (pytest.approx(1 / 3), False), 2: (0.0, False), 3: (0.0, False)}
    grid = text.dialogue_grid(spark, ["playing"], ["how"], (0.9,), (-0.7,), 1)
    lines = spark.createDataFrame([("how", "growl", ["stay back"]), ("how", "negative_high", ["too much"])], "intent string, key string, lines array<string>")
    answers = {r.voice: r.answer for r in text.compose_answers(grid, lines).collect()}
    assert answers["growl"] == "stay back" and answers[""] == "too much" and len(answers) == 9
