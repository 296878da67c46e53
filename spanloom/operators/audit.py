"""Dataset audit: one DataFrame per rule over annotations joined to their media, all with (level, code, message, subject)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.dedup import near_classes
from spanloom.operators.joins import small
from spanloom.operators.spans import overlapping_pairs
from spanloom.schema import POSTURES
from spanloom.storage import saved

FINDING = ["level", "code", "message", "subject"]
#: Splits that one audit takes: each is audited on its own.
MOST_SPLITS = 20


def finding(df: DataFrame, level: str | Column, code: str, message: Column, subject: Column) -> DataFrame:
    return df.select((F.lit(level) if isinstance(level, str) else level).alias("level"), F.lit(code).alias("code"), message.alias("message"), subject.cast("string").alias("subject"))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table per character of a, folded over b."""
    chars_a, chars_b = F.split(a, ""), F.split(b, "")
    start = F.array_repeat(F.lit(0), F.size(chars_b) + 1)

    def row(prev: Column, ch: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            taken = F.when(F.element_at(chars_b, j) == ch, F.element_at(prev, j) + 1).otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, j)))
            return F.concat(cur, F.array(taken))

        return F.aggregate(F.sequence(F.lit(1), F.size(chars_b)), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(chars_a, start, row), -1))


def similarity(a: Column, b: Column) -> Column:
    """2 * LCS / total length; 0 for an empty string."""
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(2.0 * lcs_length(a, b) / total)


def closest(names: DataFrame, labels: DataFrame, least: float = 0.6) -> DataFrame:
    """name, suggestion, score of distinct names: the first most similar label (idx, name), if above ``least``.

    The label space travels as one array beside each distinct name, so a name is one row, compared where it is.
    """
    space = labels.agg(F.array_sort(F.collect_list(F.struct("idx", F.col("name").alias("label")))).alias("space"))
    rows = names.distinct().crossJoin(F.broadcast(space))
    scored = F.transform("space", lambda x: F.struct(similarity(F.col("name"), x["label"]).alias("score"), (-x["idx"]).alias("i"), x["label"].alias("label")))
    best = rows.select("name", F.array_max(scored).alias("m")).where("m IS NOT NULL")
    return best.select("name", F.when(F.col("m.score") > least, F.col("m.label")).alias("suggestion"), F.col("m.score").alias("score"))


def checked(annotations: DataFrame, media: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Annotations (id, video, labels, start, end, group) with media (video, duration, fps, width, height) and the first
    reason why a row cannot be used: unreadable (video, error), missing_file, bad_span, or none."""
    rows = annotations.join(media, "video", "left").withColumn("stop", F.coalesce("end", "duration"))
    if unreadable is None:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    else:
        rows = rows.join(unreadable.groupBy("video").agg(F.min("error").alias("error")), "video", "left")
    reason = (
        F.when(F.col("error").isNotNull(), F.lit("unreadable"))
        .when(F.col("duration").isNull(), F.lit("missing_file"))
        .when(F.col("stop") <= F.col("start"), F.lit("bad_span"))
        .when(F.col("start") >= F.col("duration"), F.lit("bad_span"))
    )
    return rows.withColumn("reason", reason).withColumn("seconds", F.least("stop", "duration") - F.col("start"))


def audit_annotations(
    annotations: DataFrame,
    media: DataFrame,
    labels: DataFrame | None = None,
    clip_seconds: float = 1.1,
    min_examples: int = 20,
    overrun: float = 0.05,
    fps: float = 10.0,
    side: int = 128,
    signatures: DataFrame | None = None,
    distance: int = 6,
    unreadable: DataFrame | None = None,
) -> DataFrame:
    """All findings of one split. ``labels``: (idx, name, ...). ``signatures``: (id, words array<long>, all of one length)
    for near_duplicate findings, one per class of duplicates: an error if its groups differ, else a warning.
    ``unreadable``: (video, error) of media that could not be probed.

    Annotations and media are joined once and written; what a row alone shows is found in one pass over that table.
    """
    names = ["id", "video", "labels", "group", "start", "stop", "duration", "seconds", "fps", "width", "height", "reason", "error"]
    rows = saved(checked(annotations, media, unreadable).select(*names), "audited")
    present = rows.where("duration IS NOT NULL AND error IS NULL")
    usable = rows.where("reason IS NULL")
    has, fit = F.col("duration").isNotNull() & F.col("error").isNull(), F.col("reason").isNull()
    stop, start, end = F.col("stop"), F.col("start"), F.col("duration")
    rules = [
        (F.col("reason") == "missing_file", "error", "missing_file", "video not found", "group"),
        (F.col("reason") == "unreadable", "error", "unreadable", F.concat(F.lit("cannot be decoded: "), "error"), "video"),
        (has & (F.size("labels") == 0), "info", "negative", "explicit negative span", "group"),
        (has & (start < 0), "error", "bad_span", "negative start", "video"),
        (has & (stop <= start), "error", "bad_span", "end is not after start", "video"),
        (has & (stop > start) & (start >= end), "error", "bad_span", "starts after the end of the video", "video"),
        (fit & (stop > end + overrun), "warning", "span_overrun", "span ends past the end of the video", "video"),
        (fit & (F.col("seconds") < clip_seconds), "warning", "span_too_short", "span is shorter than a clip", F.array_join("labels", ",")),
        (fit & (F.col("fps") < fps), "warning", "low_fps", "motion cues will be weak", "video"),
        (fit & (F.least("width", "height") < side), "warning", "low_resolution", "below the training resolution", "video"),
    ]
    told = [
        F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(m) if isinstance(m, str) else m).alias("message"), (F.col(x) if isinstance(x, str) else x).cast("string").alias("subject")))
        for when, level, code, m, x in rules
    ]
    out = [rows.select(F.explode(F.array_compact(F.array(*told))).alias("f")).select("f.*"), contradictions(usable)]
    empty = rows.limit(1).groupBy().agg(F.count("*").alias("n")).where("n = 0")
    out.append(finding(empty, "error", "empty", F.lit("no annotations to audit"), F.lit("")))
    counts = saved(usable.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("n")), "label_counts")
    ratio = counts.agg((F.max("n") / F.greatest(F.lit(1), F.min("n"))).alias("r")).where("r > 50")
    out.append(finding(ratio, "warning", "imbalance", F.lit("the commonest class is over 50 times the rarest"), F.lit("")))
    if labels is not None:
        exploded = present.select("video", F.explode("labels").alias("name"))
        unknown = exploded.join(small(labels.select("name")), "name", "left_anti")
        hints = closest(unknown.select("name"), labels)
        hinted = unknown.join(hints, "name").withColumn("m", F.concat(F.col("name"), F.coalesce(F.concat(F.lit(": did you mean "), "suggestion", F.lit("?")), F.lit(": no close match"))))
        out.append(finding(hinted, "error", "unknown_label", F.col("m"), F.col("video")))
        out.append(thin_classes(counts, labels, min_examples))
    if signatures is not None:
        out.append(duplicate_findings(usable.select("id", "group").join(signatures.select("id", "words"), "id"), distance))
    return reduce(DataFrame.unionByName, out)


def duplicate_findings(rows: DataFrame, distance: int) -> DataFrame:
    """near_duplicate findings of rows (id, group, words): one per class of several clips."""
    first = rows.where("words IS NOT NULL").select("words").first()
    classes = near_classes(rows, "id", "words", 64 * len(first[0]) if first else 64, distance)
    found = classes.join(rows.select("id", "group"), "id").groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("group").alias("groups")).where("n > 1")
    apart = F.col("groups") > 1
    told = F.concat(F.col("n").cast("string"), F.lit(" clips are near-identical"), F.when(apart, F.concat(F.lit(" in "), F.col("groups").cast("string"), F.lit(" groups: merge these"))).otherwise(""))
    return finding(found, F.when(apart, "error").otherwise("warning"), "near_duplicate", told, F.col("class_id"))


def audit_splits(annotations: DataFrame, media: DataFrame, labels: DataFrame | None = None, signatures: DataFrame | None = None, distance: int = 6, **options) -> DataFrame:
    """split, level, code, message, subject: the findings of each split of annotations (split, ...), and with a null split
    what lies between them: groups in several splits, and with ``signatures`` classes of near duplicates in several."""
    rows = saved(annotations, "splits")
    names = sorted(r[0] for r in rows.select("split").distinct().where("split IS NOT NULL").limit(MOST_SPLITS + 1).collect())
    if len(names) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    out = []
    for name in names:
        own = audit_annotations(rows.where(F.col("split") == name).drop("split"), media, labels, signatures=signatures, distance=distance, **options)
        out.append(own.withColumn("split", F.lit(name)))
    leaks = split_leakage(rows)
    between = [finding(leaks, "error", "split_leakage", F.concat(F.lit("group is in splits "), F.array_join("splits", ", ")), F.col("group"))]
    if signatures is not None:
        marked = rows.select("id", "split").join(signatures.select("id", "words"), "id")
        first = marked.where("words IS NOT NULL").select("words").first()
        crossing = cross_split_duplicates(near_classes(marked, "id", "words", 64 * len(first[0]) if first else 64, distance), rows)
        told = F.concat(F.col("n").cast("string"), F.lit(" near-identical clips in splits "), F.array_join("splits", ", "))
        between.append(finding(crossing, "error", "cross_split_duplicate", told, F.col("class_id")))
    out += [x.withColumn("split", F.lit(None).cast("string")) for x in between]
    return reduce(DataFrame.unionByName, out).select("split", *FINDING)


def render(findings: DataFrame, totals: DataFrame, top: int = 30) -> str:
    """A text report: class balance of ``totals`` (label, n, seconds), then each level's first ``top`` findings by code."""
    classes = totals.orderBy(F.desc("n"), "label").limit(1000).collect()
    all_ = sum(r.n for r in classes)
    lines = ["dataset audit", ""] + [f"{r.label:<20}{r.n:>8} {r.seconds / 60:>9.1f} min {'#' * max(1, round(32 * r.n / max(1, all_)))}" for r in classes]
    for level in ("error", "warning"):
        rows = findings.where(F.col("level") == level)
        n = rows.count()
        lines += ["", f"{level}s: {n}"] + [f"  {r.code}: {r.message} ({r.subject})" for r in rows.orderBy("code", "subject", "message").limit(top).collect()]
        lines += [f"  and {n - top} more"] if n > top else []
    return "\n".join(lines)


def thin_classes(counts: DataFrame, labels: DataFrame, min_examples: int = 20) -> DataFrame:
    """no_examples and few_examples from (name, n) against the label space."""
    seen = labels.select("name").join(counts, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))
    none = finding(seen.where("n = 0"), "warning", "no_examples", F.col("name"), F.col("name"))
    return none.unionByName(finding(seen.where((F.col("n") > 0) & (F.col("n") < min_examples)), "warning", "few_examples", F.col("name"), F.col("name")))


def contradictions(usable: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Overlapping spans of one video that assert different postures."""
    postured = usable.withColumn("p", F.array_sort(F.array_intersect("labels", F.array(*map(F.lit, POSTURES))))).where(F.size("p") > 0)
    rows = postured.select("video", F.col("id"), "start", F.col("stop").alias("end"), "p")
    pairs = overlapping_pairs(rows, ["video"], "id", bucket).where("a_p <> b_p")
    return finding(pairs, "warning", "contradiction", F.concat(F.array_join("a_p", "+"), F.lit(" and "), F.array_join("b_p", "+")), F.col("video"))


def split_leakage(rows: DataFrame, group: str = "group", split: str = "split") -> DataFrame:
    """group, splits of groups that are in more than one split."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def cross_split_duplicates(classes: DataFrame, owners: DataFrame) -> DataFrame:
    """class_id, n, splits of the near-duplicate classes (id, class_id) whose members (id, split) are in several splits.

    A class that spans splits holds a pair of near duplicates that does; pairs are not listed.
    """
    placed = classes.select("id", "class_id").join(owners.select("id", "split"), "id")
    return placed.groupBy("class_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def totals(usable: DataFrame) -> DataFrame:
    """label, n, seconds of the usable spans."""
    return usable.select(F.explode("labels").alias("label"), "seconds").groupBy("label").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def imbalance_ratio(counts: DataFrame) -> DataFrame:
    """imbalance_ratio of (label, n): the largest count over the smallest, 0 without labels."""
    return counts.agg(F.coalesce(F.max("n") / F.greatest(F.lit(1), F.min("n")), F.lit(0.0)).alias("imbalance_ratio"))
