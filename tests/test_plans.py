import json

import pytest

from spanloom import cli
from spanloom.config import Config, Inference, from_dict, override
from spanloom.plans import predict


def scores(spark):
    rows = []
    for video, line in {"a": [0.1, 0.9, 0.9, 0.9, 0.2, 0.8, 0.9, 0.1], "b": [0.1] * 8}.items():
        for w, s in enumerate(line):
            rows += [(video, w, w * 0.5, w * 0.5 + 1.0, "playing", s), (video, w, w * 0.5, w * 0.5 + 1.0, "barking", 0.6 if w > 5 else 0.1)]
    return spark.createDataFrame(rows, "video string, w long, t0 double, t1 double, class string, score double")


def test_predict_and_report(spark):
    spans = predict.predict_spans(scores(spark), settings=Inference(smooth=3))
    got = sorted(map(tuple, spans.where("behaviour = 'playing'").select("video", "start", "end").collect()))
    assert got == [("a", 0.5, 4.0)]
    winner = predict.predict_spans(scores(spark), settings=Inference(smooth=1, min_duration=0.0, merge_gap=0.0), winner=True)
    assert sorted(map(tuple, winner.where("video = 'a'").select("behaviour", "start", "end").collect())) == [("barking", 3.5, 4.5), ("playing", 0.5, 2.5), ("playing", 2.5, 4.0)]
    videos = spark.createDataFrame([("a", 4.5), ("b", 4.5), ("c", 1.0)], "video string, duration double")
    out = {r.video: r for r in predict.reports(spans, videos).collect()}
    assert out["a"].dominant == "playing" and out["a"].affect.valence > 0 and out["c"].spans is None and out["c"].affect.label == "not enough to say"
    text = predict.timeline(out["a"].spans, 4.5, 20)
    assert text.startswith("playing") and "#" in text and predict.timeline([], 1.0) == "(no behaviours above threshold)"
    top = predict.explain(scores(spark), spark.createDataFrame([("a", 1.0)], "video string, at double"), 1).first()
    assert (top["class"], top.score) == ("playing", 0.9)


def test_prepare_keeps_copies_together(spark, tmp_path):
    rows = [(f"v{i}.mp4", ["x" if i % 3 else "y"], f"g{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "video string, labels array<string>, group string").selectExpr("*", "0D AS start", "CAST(NULL AS DOUBLE) AS end", "CAST(NULL AS STRING) AS subject", "1D AS weight", "map('k', 'v') AS meta")
    signatures = spark.createDataFrame([(f"g{i}", 0, [(i % 10) * 0x0F0F0F0F0F0F]) for i in range(30)], "group string, at int, words array<long>")
    placed = predict.prepare(df, str(tmp_path / "o"), {"train": 0.5, "val": 0.5}, 3, signatures).collect()
    where = {r.video: r.split for r in placed}
    assert len(where) == 30 and all(where[f"v{i}.mp4"] == where[f"v{i + 10}.mp4"] == where[f"v{i + 20}.mp4"] for i in range(10))
    assert sum(1 for n in ("train", "val") for f in (tmp_path / "o" / f"{n}.jsonl").glob("*.json") for _ in f.open()) == 30


def test_config():
    config = from_dict(json.loads(Config().to_json()))
    assert config == Config() and config.span_frames == 32
    override(config, "inference.smooth", "5")
    override(config, "behaviours", "a, b")
    assert config.inference.smooth == 5 and config.behaviours == ["a", "b"]
    config.model.preset = "nano"
    assert (config.with_preset().clips.frames, config.clips.image_size) == (12, 128)
    for bad in ({"nope": 1}, {"clips": {"nope": 1}}):
        with pytest.raises(KeyError):
            from_dict(bad)
    with pytest.raises(KeyError):
        override(config, "clips.nope", "1")


def test_cli(spark, tmp_path, capsys):
    csv = tmp_path / "a.csv"
    csv.write_text("video,start,end,labels\n" + "".join(f"v{i}.mp4,0,2,sitting\n" for i in range(20)))
    assert cli.main(["prepare", "csv", str(csv), str(tmp_path / "out")], spark) == 0
    written = str(next((tmp_path / "out" / "train.jsonl").glob("*.json")))
    spark.createDataFrame([(f"v{i}.mp4", 1.5, 25.0, 640, 480) for i in range(20)], "video string, duration double, fps double, width int, height int").write.parquet(str(tmp_path / "m"))
    assert cli.main(["audit", written, str(tmp_path / "m")], spark) == 0
    assert cli.main(["audit", written, str(tmp_path / "m"), "--strict"], spark) == 0
    scores(spark).write.parquet(str(tmp_path / "s"))
    assert cli.main(["--set", "inference.smooth=1", "predict", str(tmp_path / "s"), str(tmp_path / "r")], spark) == 0
    assert cli.main(["feeling", str(tmp_path / "s")], spark) == 0
    assert cli.main(["synth", str(tmp_path / "synth"), "--sessions", "5"], spark) == 0
    assert cli.main(["make-captions", written, str(tmp_path / "captions")], spark) == 0
    capsys.readouterr()
    assert cli.main(["--preset", "base", "info"]) == 0 and '"image_size": 192' in capsys.readouterr().out
    assert cli.main(["behaviours"]) == 0 and "alert_freeze action *" in capsys.readouterr().out
    assert cli.main(["--config", str(tmp_path / "none.json"), "info"]) == 1 and cli.main(["--set", "x.y=1", "info"]) == 1
