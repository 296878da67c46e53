import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources import annotations as src


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def spans(df, *extra):
    return sorted((tuple(r["labels"]), r.start, r.end, *[r[c] for c in extra]) for r in src.annotations_of(df).collect())


def test_jsonl_and_json(spark, tmp_path):
    lines = [
        {"video": "a/x.mp4", "labels": ["running", "barking"], "start": 1, "end": 2.5, "group": "g", "meta": {"k": "v"}},
        {"video": "y.mp4", "label": "sitting"}, {"video": "/abs/z.mp4", "labels": "walking", "end": ""}, {"video": "n.mp4", "labels": [], "weight": 0.5, "extra": 1},
    ]
    a = src.read_annotations(spark, put(tmp_path, "a.jsonl", "\n".join(map(json.dumps, lines))), "/root")
    got = {r.video: r for r in a.collect()}
    assert got["/root/a/x.mp4"].labels == ["running", "barking"] and got["/root/a/x.mp4"].meta == {"k": "v"} and got["/root/a/x.mp4"].end == 2.5
    assert got["/root/y.mp4"].labels == ["sitting"] and got["/root/y.mp4"].start == 0 and got["/root/y.mp4"].end is None
    assert got["/abs/z.mp4"].end is None and got["/root/n.mp4"].labels == [] and got["/root/n.mp4"].weight == 0.5
    for blob in (lines, {"annotations": lines}):
        b = src.read_annotations(spark, put(tmp_path, "b.json", blob), "/root")
        assert sorted(map(str, b.collect())) == sorted(map(str, a.collect()))
    with pytest.raises(Exception, match="no video"):
        src.read_annotations(spark, put(tmp_path, "c.jsonl", '{"labels": ["x"]}')).collect()


def test_group_key_and_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d/a.b.mp4", None), ("c.mp4", ""), ("c.mp4", "g"), (".hidden", None)], "video string, grp string")
    assert [r.k for r in df.select(src.group_key(F.col("grp"), F.col("video")).alias("k")).collect()] == ["a.b", "c", "g", ".hidden"]
    rows = src.read_annotations(spark, put(tmp_path, "a.jsonl", '{"video": "a.mp4", "labels": ["x"], "start": 1.23456, "end": 2}\n{"video": "b.mp4", "labels": []}'))
    src.write_annotations(rows, str(tmp_path / "out"))
    written = [json.loads(x) for f in sorted((tmp_path / "out").glob("*.json")) for x in f.read_text().splitlines()]
    assert sorted(written, key=str) == sorted([{"video": "a.mp4", "labels": ["x"], "start": 1.2346, "end": 2.0}, {"video": "b.mp4", "labels": [], "start": 0.0}], key=str)
    src.write_labels(rows, str(tmp_path / "names"))
    assert "".join(f.read_text() for f in (tmp_path / "names").glob("*.txt")) == "x\n"


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", "Path,begin,STOP,behaviour,dog\nv/a.mp4,1.5,3,run|Bark Loud,rex\n,1,2,x,\nb.mp4,,,sit,\n")
    out = src.read_csv(spark, path, {"run": "running"})
    assert spans(out, "video", "group", "subject") == [(("running", "bark_loud"), 1.5, 3.0, "v/a.mp4", "a", "rex"), (("sit",), 0.0, None, "b.mp4", "b", None)]
    lost = src.read_csv(spark, path, {"run": "running"}, keep_unmapped=False)
    assert {r.name: r.n for r in src.unmapped_counts(lost).collect()} == {"Bark Loud": 1, "sit": 1}
    with pytest.raises(ValueError):
        src.read_csv(spark, put(tmp_path, "b.csv", "a,b\n1,2\n"))


def test_ava(spark, tmp_path):
    path = put(tmp_path, "a.csv", "# note\nvid1,10,0,0,1,1,running\nvid1,10,0,0,1,1,barking\nvid1,20,0,0,1,1,3\nvid2,0.2,sitting\n")
    out = src.read_ava(spark, path, actions={3: "sitting"}, window=2.0)
    assert spans(out, "video") == [(("barking", "running"), 9.0, 11.0, "vid1"), (("sitting",), 0.0, 1.2, "vid2"), (("sitting",), 19.0, 21.0, "vid1")]


def test_label_studio(spark, tmp_path):
    def task(*results, fps=None, cancelled=False):
        return {"data": {"video": "/data/upload/1/a1b2c3d4-yard.mp4"}, "fps": fps, "annotations": [{"was_cancelled": cancelled, "result": [{"value": r} for r in results]}]}

    def read(tasks, *args):
        return src.read_label_studio(spark, put(tmp_path, "ls.json", tasks), *args)

    assert spans(read([task({"start": 2.0, "end": 5.5, "labels": ["running", "barking"]})]), "group") == [(("running", "barking"), 2.0, 5.5, "a1b2c3d4-yard")]
    assert spans(read([task({"timelinelabels": ["run"], "ranges": [{"start": 30, "end": 60}, {"start": 60, "end": 90}]})])) == [(("run",), 1.0, 2.0), (("run",), 2.0, 3.0)]
    assert spans(read([task({"timelinelabels": ["run"], "framesCount": 9, "ranges": [{"start": 30, "end": 60}]}, fps=15)])) == [(("run",), 2.0, 4.0)]
    assert spans(read([task({"timelinelabels": ["run"], "ranges": [{"start": 30, "end": 60}]}, fps=15)])) == [(("run",), 1.0, 2.0)]
    assert spans(read([task({"labels": ["x"]}, cancelled=True)])) == []
    assert spans(read([task({"choices": ["x"]})])) == [(("x",), 0.0, None)]
    mapped = read([task({"start": 1, "end": 2, "labels": ["Run", "Unknown Thing"]})], {"run": "running"})
    assert spans(mapped) == [(("running",), 1.0, 2.0)] and [tuple(r) for r in src.unmapped_counts(mapped).collect()] == [("Unknown Thing", 1)]
    only = read([task({"start": 1, "end": 2, "labels": ["Tail Wagging"]})], {"run": "running"})
    assert spans(only) == [] and src.unmapped_counts(only).count() == 1
    assert spans(read([task({"start": 1, "end": 2, "labels": ["Tail Wagging"]})], {"run": "running"}, True)) == [(("tail_wagging",), 1.0, 2.0)]


def test_cvat(spark, tmp_path):
    tags = "".join(f'<tag frame="{i}" label="run"/>' for i in [*range(5), *range(20, 25), 3])
    xml = f"""<?xml version="1.0"?><annotations><meta><task><name>yard.mp4</name><fps>25</fps></task></meta>{tags}
    <track label="sit"><box frame="5" outside="0"/><box frame="9" outside="0"/><box frame="10" outside="1"/></track><track label="gone"><box frame="1" outside="1"/></track></annotations>"""
    out = src.read_cvat(spark, put(tmp_path, "a.xml", xml))
    assert spans(out, "group") == [(("run",), 0.0, 0.2, "yard"), (("run",), 0.8, 1.0, "yard"), (("sit",), 0.2, 0.4, "yard")]


def test_folders_and_resolution(spark, tmp_path):
    for name in ("run/a.mp4", "run/b.txt", "sit/c.MOV"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = src.read_folders(spark, str(tmp_path))
    assert spans(rows, "group") == [(("run",), 0.0, None, "a"), (("sit",), 0.0, None, "c")]
    names = spark.createDataFrame([("/up/1/h4sh-a.mp4",), ("c",), ("x/a.mp4",), ("none",)], "name string")
    out = {r.name: r.path for r in src.resolve_videos(names, src.find_videos(spark, str(tmp_path))).collect()}
    assert out["/up/1/h4sh-a.mp4"].endswith("run/a.mp4") and out["c"].endswith("c.MOV") and out["x/a.mp4"].endswith("run/a.mp4") and out["none"] == "none"


def test_captioned(spark, tmp_path):
    lines = [{"video": "a.mp4", "captions": [{"start": 0.5, "end": 2, "text": " he runs "}, {"start": 1, "end": 1.5, "text": "on"}], "behaviors": ["Run", "run", "x"]}, {"video": "b.mp4", "behaviors": ["y"]}, {"video": "c.mp4", "behaviors": []}]
    path = put(tmp_path, "m.jsonl", "\n".join(map(json.dumps, lines)))
    out = {r.video: r for r in src.read_captioned(spark, path, {"run": "running"}, 0.4).collect()}
    assert set(out) == {"a.mp4", "b.mp4"}
    assert (out["a.mp4"].labels, out["a.mp4"].start, out["a.mp4"].end, out["a.mp4"].meta["caption"]) == (["running", "x"], pytest.approx(0.1), 2.4, "he runs on")
    assert (out["b.mp4"].start, out["b.mp4"].end) == (0.0, None)
    assert src.read_captioned(spark, path, pad=1.0).where("video = 'a.mp4'").first().start == 0.0
    assert src.read_captioned(spark, path, files=spark.createDataFrame([("b.mp4",)], "video string")).count() == 1
