"""Translation, dialogues, split discovery, samplers, renderers and written tables."""

import os

import pytest
from pyspark.sql import functions as F

from spanloom import storage
from spanloom.config import Config, load, override
from spanloom.operators import audit, joins, metrics, rules, splits, text
from spanloom.sources import annotations as src
from spanloom.sources import catalogue, dialogues

LINES = {"playing": ["Again!", "Do not stop.", "More!"], "sitting": ["I wait.", "Any minute."]}
SOUNDS = {"growl": ["Close enough.", "Stop."], "bark": ["Hey.", "Listen."]}
MOODS = {(a, v): [f"{a} {v} 1", f"{a} {v} 2"] for a in ("low", "medium", "high") for v in ("negative", "neutral", "positive")}


def pick(options, seed):
    return options[int(abs(seed) * 1000) % len(options)]


def translated(spans, events, state):
    """One video's utterances and headline, row by row."""
    rows = [(s, 1, e, pick(LINES[b], s + q), q, "behaviour", False) for b, s, e, q in spans if e - s >= 0.4 and b in LINES]
    own = [x for x in events if x[0] not in ("speech", "sound")]
    rows += [(s, 0, e, pick(SOUNDS[k], s + f / 1000), c, "voice", bad) for k, s, e, f, c, bad in own if k in SOUNDS]
    kept = []
    for s, _, e, t, c, source, bad in sorted(rows):
        if kept and kept[-1]["text"] == t and s - kept[-1]["end"] < 1.5:
            kept[-1]["end"] = max(kept[-1]["end"], e)
        else:
            kept.append({"start": s, "end": e, "text": t, "confidence": c, "source": source, "urgent": bad})
    valence, arousal = state
    mood = MOODS["high" if arousal >= 0.6 else "low" if arousal <= 0.3 else "medium", "positive" if valence >= 0.2 else "negative" if valence <= -0.15 else "neutral"]
    headline = pick(mood, valence + arousal)
    if urgent := [u for u in kept if u["urgent"]]:
        headline = max(urgent, key=lambda u: u["confidence"])["text"]
    return kept, headline if spans or own else "Not much to go on right now."


def test_translation(spark):
    spans = {
        1: [("playing", 0.0, 2.0, 0.5), ("playing", 3.0, 4.0, 0.5), ("sitting", 4.25, 4.5, 0.9), ("sitting", 6.0, 9.0, 0.5), ("sitting", 9.0, 12.0, 0.5), ("unknown", 1.0, 5.0, 0.9)],
        2: [], 3: [("playing", 1.0, 3.0, 0.75)], 4: [],
    }
    events = {1: [("growl", 3.0, 3.5, 250.0, 0.5, True), ("bark", 5.0, 5.5, 500.0, 0.5, False), ("growl", 8.0, 8.5, 125.0, 0.75, True), ("speech", 1.0, 2.0, 100.0, 0.5, False)], 2: [], 3: [], 4: [("bark", 1.0, 1.5, 250.0, 0.5, False)]}
    states = {1: (-0.5, 0.75), 2: (0.0, 0.0), 3: (0.5, 0.5), 4: (0.0, 0.25)}
    told = rules.translate(
        spark.createDataFrame([(v, *x) for v, rows in spans.items() for x in rows], "video long, behaviour string, start double, end double, score double"),
        spark.createDataFrame([(v, *x) for v, rows in events.items() for x in rows], "video long, kind string, start double, end double, f0 double, confidence double, concerning boolean"),
        spark.createDataFrame([(v, *x, 0.5, False) for v, x in states.items()], "video long, valence double, arousal double, confidence double, disagree boolean"),
        ["video"],
        spark.createDataFrame(list(LINES.items()), "behaviour string, lines array<string>"),
        spark.createDataFrame(list(SOUNDS.items()), "kind string, lines array<string>"),
        spark.createDataFrame([(*k, v) for k, v in MOODS.items()], "arousal_band string, valence_band string, lines array<string>"),
    )
    out = {r.video: r for r in told.collect()}
    for v in spans:
        kept, headline = translated(spans[v], events[v], states[v])
        assert out[v].headline == headline
        assert [{k: u[k] for k in ("start", "end", "text", "confidence", "source", "urgent")} for u in out[v].utterances] == kept
    assert out[1].urgent == ["growl"] and (out[1].heard, out[1].saw, out[2].heard, out[3].heard, out[4].saw) == (True, True, False, False, False)
    assert out[2].confidence == 0.0 and out[3].notes == ["silent: read from movement alone"] and out[1].notes[0].startswith("1 sounds")


def test_dialogues_and_corpora(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [("Are you ok?\nReally", "Yes é", "mood", "sitting", "", 0.5, -0.25), ("q", "a", "", "running", "bark", 0.0, 1.0)]
    dialogues.write_dialogues(spark.createDataFrame(rows, "question string, answer string, intent string, behaviour string, voice string, arousal double, valence double"), path)
    assert sorted(map(tuple, dialogues.read_dialogues(spark, path).collect())) == sorted(rows)
    (tmp_path / "c.jsonl").write_text('{"video": "v.mp4", "caption": "It sits."}\n{"video": "w.mp4", "caption": "x", "labels": ["a"], "audio": {"kinds": {"bark": 2}}, "duration": 1.23456}\n')
    back = dialogues.read_corpus(spark, str(tmp_path / "c.jsonl"))
    got = {r.video: r for r in back.collect()}
    assert got["v.mp4"].labels == [] and got["v.mp4"].duration == 0.0 and got["v.mp4"].audio.kinds == {} and got["w.mp4"].audio.kinds == {"bark": 2}
    dialogues.write_corpus(back, path)
    assert {r.video: r.duration for r in dialogues.read_corpus(spark, path).collect()} == {"v.mp4": 0.0, "w.mp4": 1.235}
    (tmp_path / "bad.jsonl").write_text('{"video": "v.mp4"}\n')
    with pytest.raises(Exception, match="no caption"):
        dialogues.read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()


def test_split_discovery(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"video": "a.mp4", "label": "run"}\n')
    (tmp_path / "train.json").write_text('[{"video": "b.mp4", "label": "run"}]')
    (tmp_path / "val.json").write_text('[{"video": "b.mp4", "label": "run"}]')
    (tmp_path / "test" / "sit").mkdir(parents=True)
    (tmp_path / "test" / "sit" / "c.mp4").write_text("x")
    videos = lambda s: [os.path.basename(r.video) for r in src.discover_split(spark, str(tmp_path), s).collect()]
    assert (videos("train"), videos("val"), videos("test")) == (["a.mp4"], ["b.mp4"], ["c.mp4"])
    with pytest.raises(FileNotFoundError):
        src.discover_split(spark, str(tmp_path), "none")


def test_cvat_folder(spark, tmp_path):
    for i, fps in ((1, 25), (2, 10)):
        (tmp_path / f"{i}.xml").write_text(f'<annotations><meta><task><name>v{i}.mp4</name><fps>{fps}</fps></task></meta><tag frame="0" label="l{i}"></tag></annotations>')
    out = sorted((r.video, r.labels, r.end) for r in src.read_cvat(spark, str(tmp_path)).collect())
    assert out == [("v1.mp4", ["l1"], 0.04), ("v2.mp4", ["l2"], 0.1)]


def test_sampler_dispatch(spark):
    df = spark.createDataFrame([(i, ["a"] if i else ["b"]) for i in range(60)], "id long, labels array<string>")
    assert splits.build_sampler(df, "id", "labels", balanced=False) is None
    repeats = splits.build_sampler(df, "id", "labels")
    assert repeats.where("id = 0").count() >= 1 and {r.id for r in repeats.collect()} == set(range(60))
    drawn = splits.build_sampler(df, "id", "labels", multilabel=False, seed=3)
    assert drawn.count() == 60 and 15 < drawn.where("id = 0").count() < 45
    assert drawn.collect() != splits.build_sampler(df, "id", "labels", multilabel=False, seed=3, epoch=1).collect()


def test_question_answer_pairs(spark):
    row = lambda q, a, n: spark.range(1).select(text.question_answer(F.array(*map(F.lit, q)).cast("array<long>"), F.array(*map(F.lit, a)).cast("array<long>"), n, 4).alias("p")).first().p
    p = row([10, 11], [20, 21, 22], 9)
    assert p.input == [1, 10, 11, 4, 20, 21, 22, 0, 0] and p.target == [0, 0, 0, 20, 21, 22, 2, 0, 0]
    p = row([10, 11, 12], [20], 2)
    assert p.input == [1, 10] and p.target == [10, 11]


def test_encode_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The dog, the dog's bone."), (2, ""), (3, None), (3, "zzz the"), (4, "unknown words only")], "id long, text string")
    vocab = text.vocabulary(spark.createDataFrame([("the dog , . bone the",)], "text string"), "text")
    ids = {r.token: r.id for r in vocab.collect()}
    want = lambda t: [1, *(ids.get(x, 3) for x in __import__("re").findall(text.TOKEN, (t or "").lower())), 2]
    expected = sorted((r.id, want(r.text)) for r in docs.collect())
    for most in (text.MOST_SHIPPED, 2):
        monkeypatch.setattr(text, "MOST_SHIPPED", most)
        assert sorted((r.id, r.ids) for r in text.encode(docs, "id", "text", vocab).collect()) == expected


def test_renderers(spark):
    per = spark.createDataFrame([("b", 0.5, 3), ("a", None, 1)], "class string, ap double, support long")
    lines = metrics.table(per).splitlines()
    assert lines[0].split() == ["class", "ap", "support"] and lines[2].split() == ["a", "n/a", "1"] and lines[3].split() == ["b", "0.5000", "3"]
    square = metrics.format_confusion(spark.createDataFrame([("x", "x", 2), ("x", "y", 1), ("y", "x", 0), ("y", "y", 4)], "truth string, predicted string, n long")).splitlines()
    assert [x.split() for x in square] == [["x", "y"], ["x", "2", "1"], ["y", "0", "4"]]
    found = spark.createDataFrame([("error", "bad_span", "m", f"v{i}") for i in range(4)] + [("warning", "low_fps", "m", "w")], "level string, code string, message string, subject string")
    report = audit.render(found, spark.createDataFrame([("run", 3, 120.0)], "label string, n long, seconds double"), top=2)
    assert "errors: 4" in report and "and 2 more" in report and "2.0 min" in report
    assert "dog-behavior" in catalogue.describe(catalogue.catalogue(spark))
    with pytest.raises(KeyError):
        catalogue.download("none", "/nowhere")


def test_split_audit(spark):
    names = "id long, video string, labels array<string>, start double, end double, group string, split string"
    rows = [(1, "a", ["sitting"], 0.0, 2.0, "g1", "train"), (2, "b", ["sitting"], 0.0, 2.0, "g1", "val"), (3, "c", ["sittin"], 0.0, 2.0, "g2", "val"), (4, "d", ["sitting"], 0.0, 2.0, "g3", "train"), (5, "e", [], 0.0, 2.0, "g4", "train")]
    media = spark.createDataFrame([(v, 5.0, 25.0, 640, 480) for v in "abce"], "video string, duration double, fps double, width int, height int")
    labels = spark.createDataFrame([(0, "sitting"), (1, "running")], "idx int, name string")
    signatures = spark.createDataFrame([(1, [0, 0]), (3, [0, 3]), (2, [-1, -1])], "id long, words array<long>")
    unreadable = spark.createDataFrame([("e", "no stream")], "video string, error string")
    found = [tuple(r) for r in audit.audit_splits(spark.createDataFrame(rows, names), media, labels, signatures, min_examples=1, unreadable=unreadable).select("split", "code", "subject").collect()]
    assert {(None, "split_leakage", "g1"), (None, "cross_split_duplicate", "1"), ("val", "unknown_label", "c"), ("train", "missing_file", "g3"), ("train", "unreadable", "e"), ("val", "no_examples", "running")} <= set(found)
    assert ("train", "missing_file", "g4") not in found and not [x for x in found if x[1] == "near_duplicate"]
    one = spark.createDataFrame([x[:6] for x in rows], names.rsplit(",", 1)[0])
    near = audit.audit_annotations(one, media, signatures=signatures, distance=2).where("code = 'near_duplicate'").collect()
    assert [(r.level, r.subject) for r in near] == [("error", "1")]


def test_written_tables_go(spark):
    first = storage.saved(spark.range(3), "first")
    with storage.scratch(spark) as kept:
        second, third = storage.saved(spark.range(2), "second"), storage.saved(spark.range(1), "third")
        kept.append(third)
    folder = lambda df: df._spanloom_path.removeprefix("file:")
    assert os.path.isdir(folder(first)) and os.path.isdir(folder(third)) and not os.path.exists(folder(second))
    storage.drop(first)
    assert not os.path.exists(folder(first)) and third.count() == 1
    storage.release(spark)
    assert not os.path.exists(folder(third))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _jsc = spark.sparkContext._jsc

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not kept.isDefined():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            storage.shared_dir(Session())
    else:
        assert storage.shared_dir(Session())


def test_checked_broadcast(spark):
    plan = lambda n: joins.small(spark.range(10), n)._jdf.queryExecution().toString()
    assert "broadcast" in plan(10) and "broadcast" not in plan(9)


def test_settings_files(tmp_path):
    (tmp_path / "c.json").write_text('{"inference": {"smooth": 7}, "task": "multiclass"}')
    config = load(str(tmp_path / "c.json"))
    assert config.inference.smooth == 7 and config.inference.threshold == Config().inference.threshold and config.task == "multiclass"
    override(config, "inference.threshold", "0.25")
    override(config, "clips.frames", "24")
    assert (config.inference.threshold, config.clips.frames) == (0.25, 24)
    for name, value in (("clips.frames", "many"), ("inference.smooth", "x1")):
        with pytest.raises(ValueError):
            override(config, name, value)
    for name in ("clips", "clips.none", "inference.smooth.more"):
        with pytest.raises(KeyError):
            override(config, name, "1")


def test_captions_of_annotations(spark):
    rows = spark.createDataFrame([("a", ["sitting"], 0.0, 3.0, "g"), ("b", [], 1.0, None, None), ("c", ["playing", "barking"], 0.0, 20.0, "")], "video string, labels array<string>, start double, end double, `group` string")
    audio = spark.createDataFrame([("a", {"growl": 2, "bark": 2}, 0.5, -0.5, 0.1), ("b", {"whine": 0}, 0.0, 0.0, 0.0)], "video string, kinds map<string,long>, arousal double, valence double, vocal_fraction double")
    out = {r.video: r for r in text.generate_captions(rows, audio).collect()}
    assert "sitting for a moment" in out["a"].caption and "bark twice" in out["a"].caption and out["a"].audio.kinds == {"growl": 2, "bark": 2}
    assert out["b"].caption == "Nothing much happens in this clip." and out["b"].duration == 0.0 and "playing for a long time" in out["c"].caption
    silent = {r.video: r.caption for r in text.generate_captions(rows).collect()}
    assert silent["c"] == out["c"].caption and "bark" not in silent["a"]
    examples = {r.video: r.condition for r in text.corpus_to_examples(text.generate_captions(rows, audio), ["sitting", "playing"]).collect()}
    assert examples["a"][:2] == pytest.approx([0.925, 0.075]) and examples["b"][:2] == [0.0, 0.0] and all(len(x) == 2 + 8 + 4 for x in examples.values())


def test_translation_of_scores(spark):
    from spanloom.plans import predict

    scores = spark.createDataFrame([("v", w, w * 0.5, w * 0.5 + 1, "playing", 0.9) for w in range(6)] + [("w", 0, 0.0, 1.0, "playing", 0.1)], "video string, w long, t0 double, t1 double, class string, score double")
    events = spark.createDataFrame([("v", "growl", 1.0, 1.5, 0.5, 250.0, 0.75, -0.6, 0.6, True)], "video string, kind string, start double, end double, seconds double, f0 double, confidence double, valence double, arousal double, concerning boolean")
    videos = spark.createDataFrame([("v", 3.5), ("w", 1.0)], "video string, duration double")
    dims = [spark.createDataFrame(list(LINES.items()), "behaviour string, lines array<string>"), spark.createDataFrame(list(SOUNDS.items()), "kind string, lines array<string>"), spark.createDataFrame([(*k, v) for k, v in MOODS.items()], "arousal_band string, valence_band string, lines array<string>")]
    out = {r.video: r for r in predict.translated(scores, events, videos, *dims).collect()}
    assert out["v"].headline in SOUNDS["growl"] and out["v"].disagree and len(out["v"].utterances) == 2
    assert out["w"].headline == "Not much to go on right now." and not out["w"].saw
