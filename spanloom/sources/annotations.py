"""Readers and writers of annotation exports; every reader gives the columns of schema.ANNOTATION.

Paths go to Spark's readers only. Whole-document formats (Label Studio, CVAT) are a row per file, so many exports are read
in parallel and one large export is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.spans import frame_runs
from spanloom.schema import ANNOTATION

COLUMNS = [c.strip().split(" ")[0].strip("`") for c in ANNOTATION.replace("map<string,string>", "map").split(",")]
#: Suffixes of video files, and the names that CSV exports give to the columns.
VIDEO_SUFFIXES = [".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v", ".mpg", ".mpeg"]
ALIASES = {
    "video": ["video", "file", "path", "clip", "filename", "video_id"],
    "start": ["start", "start_time", "begin", "from", "t0"],
    "end": ["end", "end_time", "stop", "to", "t1"],
    "labels": ["labels", "label", "behaviour", "behavior", "action", "class"],
    "group": ["group", "source", "session", "video_group"],
    "subject": ["subject", "dog", "animal", "individual"],
}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; a leading dot is no suffix."""
    name = base_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def group_key(group: Column, video: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), stem(video))


def normalised(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))


def map_labels(raw: Column, mapping: dict[str, str] | None, keep_unmapped: bool) -> tuple[Column, Column]:
    """(labels in order, once each; the names that no entry maps and that are dropped, repeats kept)."""
    names = F.filter(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda n: F.btrim(n, F.lit(" \t\r\n"))), lambda n: n != "")
    if mapping is None:
        return F.array_distinct(names), F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    found = lambda n: F.coalesce(F.try_element_at(table, normalised(n)), F.try_element_at(table, n))
    kept = F.transform(names, lambda n: F.coalesce(found(n), normalised(n) if keep_unmapped else F.lit(None)))
    lost = F.array().cast("array<string>") if keep_unmapped else F.filter(names, lambda n: found(n).isNull())
    return F.array_distinct(F.array_compact(kept)), lost


def import_report(annotations: DataFrame) -> DataFrame:
    """n_spans, n_videos, n_groups."""
    return annotations.agg(F.count("*").alias("n_spans"), F.count_distinct("video").alias("n_videos"), F.count_distinct(group_key(F.col("group"), F.col("video"))).alias("n_groups"))


def unmapped_counts(rows: DataFrame, lost: str = "unmapped") -> DataFrame:
    return rows.select(F.explode(lost).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def shaped(df: DataFrame, **columns: Column) -> DataFrame:
    """The annotation columns (absent ones null, weight 1, start 0) and unmapped."""
    default = {"start": F.lit(0.0), "weight": F.lit(1.0), "meta": F.create_map().cast("map<string,string>"), "labels": F.array().cast("array<string>")}
    kinds = {"labels": "array<string>", "start": "double", "end": "double", "weight": "double", "meta": "map<string,string>"}
    out = [columns.get(c, default.get(c, F.lit(None))).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]
    return df.select(*out, columns.get("unmapped", F.array().cast("array<string>")).alias("unmapped"))


def read_annotations(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """JSON Lines, or (.json) a list or an object with "annotations". labels may be a string or be named label.

    A row without a video raises when it is read.
    """
    names = ["video string", "labels string", "label string", "start string", "end string", "`group` string", "subject string", "weight double", "meta map<string,string>"]
    raw = ", ".join(names)
    if path.endswith(".json"):
        whole = spark.read.schema(f"annotations array<struct<{', '.join(n.replace(' ', ': ', 1) for n in names)}>>, {raw}").json(path, multiLine=True)
        listed = whole.where("annotations IS NOT NULL").select(F.inline("annotations"))
        df = listed.unionByName(whole.where("annotations IS NULL").drop("annotations"))
    else:
        df = spark.read.schema(raw).json(path)
    named = F.coalesce("labels", "label")
    labels = F.when(named.startswith("["), F.from_json(named, "array<string>")).when(named.isNull() | (named == ""), F.array().cast("array<string>")).otherwise(F.array(named))
    video = F.coalesce("video", F.raise_error(F.lit("an annotation has no video")))
    if root:
        video = F.when(video.startswith("/") | video.contains("://"), video).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), video))
    number = lambda c: F.nullif(F.col(c), F.lit("")).try_cast("double")
    return shaped(
        df, video=video, labels=labels, start=F.coalesce(number("start"), F.lit(0.0)), end=number("end"), group=F.col("group"), subject=F.col("subject"),
        weight=F.coalesce("weight", F.lit(1.0)), meta=F.coalesce("meta", F.create_map().cast("map<string,string>")),
    ).drop("unmapped")


def discover_split(spark: SparkSession, root: str, split: str) -> DataFrame:
    """The annotations of a split under a folder: root/split.jsonl, else root/split.json, else the folders of root/split."""
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for name in (f"{split}.jsonl", f"{split}.json"):
        at = paths(f"{root.rstrip('/')}/{name}")
        if at.getFileSystem(conf).exists(at):
            return read_annotations(spark, f"{root.rstrip('/')}/{name}", root)
    at = paths(f"{root.rstrip('/')}/{split}")
    if at.getFileSystem(conf).exists(at):
        return annotations_of(read_folders(spark, f"{root.rstrip('/')}/{split}"))
    raise FileNotFoundError(f"{root} has no {split}.jsonl, {split}.json or {split}/")


def write_annotations(df: DataFrame, path: str) -> None:
    """JSON Lines; null fields, weight 1 and an empty meta are left out, times have four decimals."""
    meta = F.when(F.size("meta") > 0, F.col("meta"))
    weight = F.when(F.col("weight") != 1, F.col("weight"))
    out = df.select("video", "labels", F.bround("start", 4).alias("start"), F.bround("end", 4).alias("end"), "group", "subject", weight.alias("weight"), meta.alias("meta"))
    out.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_labels(df: DataFrame, path: str) -> None:
    df.select(F.explode("labels").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, keep_unmapped: bool = True, separator: str = "|") -> DataFrame:
    """A header names the columns, in any case and by any alias; of several aliases of one name the last counts."""
    df = spark.read.option("header", "true").csv(path)
    chosen = {}
    for column in df.columns:
        for name, aliases in ALIASES.items():
            if column.strip().lower() in aliases:
                chosen[name] = F.col(f"`{column}`")
    if "video" not in chosen or "labels" not in chosen:
        raise ValueError(f"{path}: a video and a labels column are needed, not {df.columns}")
    text = lambda c: F.nullif(F.trim(F.coalesce(chosen.get(c, F.lit("")), F.lit(""))), F.lit(""))
    raw = F.split(F.coalesce(chosen["labels"], F.lit("")), f"\\Q{separator}\\E")
    labels, lost = map_labels(raw, mapping, keep_unmapped)
    rows = df.where(text("video").isNotNull())
    return shaped(
        rows, video=text("video"), labels=labels, unmapped=lost, start=F.coalesce(text("start").cast("double"), F.lit(0.0)), end=text("end").cast("double"),
        group=F.coalesce(text("group"), stem(text("video"))), subject=text("subject"), meta=F.create_map(F.lit("source"), F.lit("csv")),
    )


def read_ava(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, actions: dict[int, str] | None = None, keep_unmapped: bool = False, window: float = 1.5) -> DataFrame:
    """Headerless video, time, box, action rows; the actions of one time are one span of ``window`` seconds around it."""
    df = spark.read.schema(", ".join(f"_c{i} string" for i in range(8))).option("comment", "#").csv(path)
    raw = F.trim(F.coalesce("_c6", "_c2", F.lit("")))
    if actions:
        table = F.create_map(*[F.lit(str(x)) for kv in actions.items() for x in kv])
        raw = F.coalesce(F.try_element_at(table, F.when(raw.rlike("^[0-9]+$"), raw.cast("int").cast("string"))), raw)
    labels, lost = map_labels(F.array(raw), mapping, keep_unmapped)
    rows = df.where("_c1 IS NOT NULL").select(F.col("_c0").alias("v"), F.col("_c1").cast("double").alias("t"), labels.alias("l"), lost.alias("u"))
    merged = rows.groupBy("v", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("l")))).alias("l"), F.flatten(F.collect_list("u")).alias("u"))
    found = merged.where((F.size("l") > 0) | (F.size("u") > 0))
    out = shaped(
        found, video=F.col("v"), labels=F.col("l"), unmapped=F.col("u"), start=F.greatest(F.lit(0.0), F.col("t") - window / 2), end=F.col("t") + window / 2, group=stem(F.col("v")),
        meta=F.create_map(F.lit("source"), F.lit("ava"), F.lit("keyframe"), F.col("t").cast("string")),
    )
    return out


def read_label_studio(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, keep_unmapped: bool = False, fps: float = 30.0) -> DataFrame:
    """Tasks of a JSON export: ranges of frames, seconds, or whole clips; cancelled records are left out."""
    value = "struct<timelinelabels: array<string>, labels: array<string>, choices: array<string>, ranges: array<struct<start: double, end: double>>, start: double, end: double, framesCount: long>"
    record = f"array<struct<was_cancelled: boolean, result: array<struct<value: {value}>>>>"
    schema = f"data map<string,string>, fps double, annotations {record}, completions {record}"
    df = spark.read.schema(schema).json(path, multiLine=True)
    suffix = "|".join(s.replace(".", r"\.") for s in VIDEO_SUFFIXES)
    source = F.get(F.filter(F.map_entries("data"), lambda e: e["value"].isNotNull() & (e["key"].contains("video") | F.lower(e["value"]).rlike(f"({suffix})$"))), F.lit(0))["value"]
    some = lambda a: F.when(F.size(a) > 0, F.col(a) if isinstance(a, str) else a)
    tasks = df.select(source.alias("video"), "fps", F.explode(F.coalesce(some("annotations"), F.col("completions"))).alias("r")).where("video IS NOT NULL AND NOT coalesce(r.was_cancelled, false)")
    regions = tasks.select("video", "fps", F.explode("r.result").alias("x")).select("video", "fps", "x.value.*")
    names = F.coalesce(some(F.col("timelinelabels")), some(F.col("labels")), some(F.col("choices")), F.array().cast("array<string>"))
    labels, lost = map_labels(names, mapping, keep_unmapped)
    rate = F.when(F.coalesce("framesCount", F.lit(0)) != 0, F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(fps))).otherwise(F.lit(fps))
    rows = regions.withColumn("l", labels).withColumn("u", lost).withColumn("named", F.size(names) > 0).withColumn("rate", rate)
    frames = F.transform("ranges", lambda s: F.struct((F.coalesce(s["start"], F.lit(0.0)) / F.col("rate")).alias("s"), (F.coalesce(s["end"], F.lit(0.0)) / F.col("rate")).alias("e")))
    none = F.lit(None).cast("double")
    spans = (
        F.when(F.size("ranges") > 0, frames)
        .when(F.col("start").isNotNull(), F.array(F.struct(F.col("start").alias("s"), F.coalesce("end", "start").alias("e"))))
        .when(F.size("l") > 0, F.array(F.struct(F.lit(0.0).alias("s"), none.alias("e"))))
    )
    kept = rows.withColumn("spans", F.when((F.size("l") > 0) | ~F.col("named"), spans))
    out = kept.select("*", F.explode_outer("spans").alias("p")).where("p IS NOT NULL OR size(u) > 0")
    return shaped(out, video=F.col("video"), labels=F.when(F.col("p").isNotNull(), F.col("l")), unmapped=F.col("u"), start=F.col("p.s"), end=F.col("p.e"), group=stem(F.col("video")), meta=F.create_map(F.lit("source"), F.lit("label-studio")))


def read_cvat(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, keep_unmapped: bool = False, fps: float = 30.0) -> DataFrame:
    """XML, a video per file: tags on frames become runs per label, tracks the range of their boxes that are not outside.

    Every element is joined to its own file's head, so a folder of exports is read at once.
    """
    reader = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    xml = lambda tag, schema: reader(tag, schema).withColumn("file", F.col("_metadata.file_path"))
    meta = xml("annotations", "meta struct<source: string, task: struct<name: string, source: string, fps: double>>")
    task = meta.select(
        "file", F.coalesce("meta.source", "meta.task.source", "meta.task.name", F.lit("video")).alias("video"), F.coalesce(F.nullif(F.col("meta.task.fps"), F.lit(0.0)), F.lit(fps)).alias("fps")
    )

    def labelled(df: DataFrame) -> DataFrame:
        labels, lost = map_labels(F.array("_label"), mapping, keep_unmapped)
        return df.withColumn("l", labels).withColumn("u", lost)

    tags = labelled(xml("tag", "_label string, _frame long").where("_label IS NOT NULL AND _frame IS NOT NULL"))
    runs = frame_runs(tags.select("file", F.explode("l").alias("name"), F.col("_frame").alias("frame")), ["file", "name"], "frame")
    spans = runs.select("file", F.array("name").alias("l"), "first", "last")
    tracks = labelled(xml("track", "_label string, box array<struct<_frame: long, _outside: string>>").where("_label IS NOT NULL"))
    seen = F.transform(F.filter("box", lambda b: F.coalesce(b["_outside"], F.lit("0")) != "1"), lambda b: F.coalesce(b["_frame"], F.lit(0)))
    boxes = tracks.where(F.size("l") > 0).select("file", "l", F.array_min(seen).alias("first"), F.array_max(seen).alias("last")).where("first IS NOT NULL")
    lost = tags.select("file", "u").unionByName(tracks.select("file", "u")).where(F.size("u") > 0)
    all_ = spans.unionByName(boxes).withColumn("u", F.array().cast("array<string>"))
    all_ = all_.unionByName(lost.select("file", F.lit(None).cast("array<string>").alias("l"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), "u"))
    rows = all_.join(task, "file")
    return shaped(
        rows, video=F.col("video"), labels=F.col("l"), unmapped=F.col("u"), start=F.col("first") / F.col("fps"), end=(F.col("last") + 1) / F.col("fps"), group=stem(F.col("video")),
        meta=F.create_map(F.lit("source"), F.lit("cvat")),
    )


def annotations_of(rows: DataFrame) -> DataFrame:
    """An import without the rows that only carry unmapped names."""
    return rows.where("labels IS NOT NULL AND (start IS NOT NULL OR `end` IS NOT NULL)").drop("unmapped")


def find_videos(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of the video files under a folder; contents are not read."""
    pattern = "*{" + ",".join([*VIDEO_SUFFIXES, *(s.upper() for s in VIDEO_SUFFIXES)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_folders(spark: SparkSession, root: str, mapping: dict[str, str] | None = None, keep_unmapped: bool = True) -> DataFrame:
    """root/<label>/clip: one whole-clip row per file; files whose label is not mapped carry it as unmapped."""
    label = F.element_at(F.split("path", "/"), -2)
    labels, lost = map_labels(F.array(label), mapping, keep_unmapped)
    return shaped(find_videos(spark, root), video=F.col("path"), labels=labels, unmapped=lost, group=stem(F.col("path")), meta=F.create_map(F.lit("source"), F.lit("folders"))).where("size(labels) > 0 OR size(unmapped) > 0")


def read_captioned(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, pad: float = 0.0, files: DataFrame | None = None) -> DataFrame:
    """Metadata JSON Lines with behaviours and timed captions: one span from the first caption's start to the last's end.

    ``files`` (video) restricts the rows to files that exist. A span that padding leaves empty lasts to the end of the clip.
    """
    df = spark.read.schema("video string, fps double, captions array<struct<start: double, end: double, text: string>>, behaviors array<string>, tags array<string>").json(path)
    if files is not None:
        df = df.join(files.select("video"), "video", "left_semi")
    table = F.create_map(*[F.lit(x) for kv in (mapping or {"": ""}).items() for x in kv])
    labels = F.array_distinct(F.filter(F.transform("behaviors", lambda b: F.coalesce(F.try_element_at(table, F.lower(b)), F.lower(b))), lambda x: x != ""))
    some = F.size("captions") > 0
    start = F.greatest(F.lit(0.0), F.array_min(F.transform("captions", lambda c: F.coalesce(c["start"], F.lit(0.0)))) - pad)
    end = F.array_max(F.transform("captions", lambda c: F.coalesce(c["end"], F.lit(0.0)))) + pad
    text = F.trim(F.array_join(F.transform("captions", lambda c: F.trim(F.coalesce(c["text"], F.lit("")))), " "))
    rows = df.withColumn("l", labels).where(F.size("l") > 0)
    meta = F.map_concat(F.create_map(F.lit("source"), F.lit("captioned")), F.create_map(F.lit("caption"), F.coalesce(text, F.lit(""))))
    return shaped(rows, video=F.col("video"), labels=F.col("l"), start=F.when(some, start).otherwise(0.0), end=F.when(some & (end > start), end), group=stem(F.col("video")), meta=meta).drop("unmapped")


def resolve_videos(names: DataFrame, files: DataFrame) -> DataFrame:
    """name, path: by the file name, then the stem without an upload prefix, then the stem; the first path of equals, else the name.

    names (name), files (path). Each name has at most three keys, so this is an equi-join on keys, not a search.
    """
    own = stem(F.col("name"))
    keys = F.array(
        F.struct(F.lit(0).alias("p"), base_name(F.col("name")).alias("k")),
        F.struct(F.lit(1).alias("p"), F.concat(F.lit("stem:"), F.regexp_replace(own, "^[^-]*-", "")).alias("k")),
        F.struct(F.lit(2).alias("p"), F.concat(F.lit("stem:"), own).alias("k")),
    )
    listed = files.select("path", F.explode(F.array(base_name(F.col("path")), F.concat(F.lit("stem:"), stem(F.col("path"))))).alias("k"))
    tried = names.select("name", F.explode(keys).alias("x")).select("name", "x.p", "x.k").join(listed, "k")
    best = tried.groupBy("name").agg(F.min(F.struct("p", "path")).alias("m"))
    return names.join(best, "name", "left").select("name", F.coalesce("m.path", "name").alias("path"))


IMPORTERS = {"label-studio": read_label_studio, "cvat": read_cvat, "csv": read_csv, "ava": read_ava, "folders": read_folders}
