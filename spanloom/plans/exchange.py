"""Queries on importers, round trips through files, media tables, reports and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.config import Inference
from spanloom.functions import numbers
from spanloom.operators import audit, rules, text
from spanloom.plans import predict
from spanloom.plans.bindings import BEHAVIOUR_OF, CASE, EPOCH, SPANS, TOTALS, WINDOWS, micros, spans, table, totals, windows
from spanloom.plans.quality import AUDIT, AUDITED, VOICED, annotations, blended, media, voice_features
from spanloom.plans.registry import register
from spanloom.schema import AROUSAL_FLAGS, label_dim, voice_dim
from spanloom.sources import annotations as src
from spanloom.sources import catalogue, dialogues
from spanloom.sources import media as md
from spanloom.storage import shared_path


def hours(ts: str):
    return F.floor((micros(ts) - EPOCH) / 3600000000).cast("long")


HOUR = f"CAST((epoch_us(ts) - {EPOCH}) // 3600000000 AS BIGINT)"


def timed(spark, sf_dir):
    """events as annotations on whole hours: id, video, label, h."""
    names = F.create_map(*[F.lit(x) for kv in BEHAVIOUR_OF.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id"), F.lit(".mp4")).alias("video"), F.col("event_type").alias("type"), names[F.col("event_type")].alias("label"), hours("ts").alias("h")
    )


TIMED = f"ti AS (SELECT event_id AS id, 'u' || user_id || '.mp4' AS video, event_type AS type, {CASE} AS label, {HOUR} AS h FROM events)"


def as_annotations(rows):
    meta = F.create_map(F.lit("id"), F.col("id").cast("string"))
    return src.shaped(rows, video=F.col("video"), labels=F.array("label"), start=F.col("h").cast("double"), end=F.col("h") + 1.5, group=F.col("type"), meta=meta).drop("unmapped")


@register("annotation_round_trip", f"""WITH {TIMED} SELECT id, video, label, CAST(h AS DOUBLE) AS start, h + 1.5e0 AS "end", type AS "group", 1e0 AS weight FROM ti""")
def annotation_round_trip(spark, sf_dir):
    path = shared_path(spark, "annotations.jsonl")
    src.write_annotations(as_annotations(timed(spark, sf_dir)), path)
    return src.read_annotations(spark, path).select(F.col("meta")["id"].cast("long").alias("id"), "video", F.col("labels")[0].alias("label"), "start", "end", "group", "weight")


@register("discovered_split", f"WITH {TIMED} SELECT label, count(*) AS n, count(DISTINCT video) AS videos FROM ti GROUP BY label")
def discovered_split(spark, sf_dir):
    root = shared_path(spark, "split")
    src.write_annotations(as_annotations(timed(spark, sf_dir)), f"{root}/train.jsonl")
    return src.discover_split(spark, root, "train").groupBy(F.col("labels")[0].alias("label")).agg(F.count("*").alias("n"), F.count_distinct(src.base_name(F.col("video"))).alias("videos"))


@register("label_list", f"WITH {TIMED} SELECT DISTINCT label AS value FROM ti")
def label_list(spark, sf_dir):
    path = shared_path(spark, "behaviours")
    src.write_labels(as_annotations(timed(spark, sf_dir)), path)
    return spark.read.text(path)


@register(
    "csv_import",
    f"""WITH {TIMED} SELECT id, video, CAST(h AS DOUBLE) AS start, h + 0.5e0 AS "end", CASE type WHEN 'view' THEN 'sniffing' ELSE type END || ',extra_one' AS labels, 's' || (id % 7) AS "group" FROM ti""",
)
def csv_import(spark, sf_dir):
    path = shared_path(spark, "rows.csv")
    rows = timed(spark, sf_dir)
    rows.select(
        F.col("video").alias("File"), F.col("h").alias("Begin"), (F.col("h") + 0.5).alias("Stop"), F.concat("type", F.lit("| Extra One")).alias("Label"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("Session"),
        F.col("id").alias("Dog"),
    ).write.option("header", "true").csv(path)
    found = src.read_csv(spark, path, {"view": "sniffing"}, keep_unmapped=True)
    return found.select(F.col("subject").cast("long").alias("id"), "video", "start", "end", F.array_join("labels", ",").alias("labels"), "group")


@register(
    "ava_import",
    f"""WITH {TIMED} SELECT video, greatest(0e0, h - 0.75e0) AS start, h + 0.75e0 AS "end", array_to_string(list_sort(list_distinct(list(type))), ',') AS labels FROM ti GROUP BY video, h""",
)
def ava_import(spark, sf_dir):
    path = shared_path(spark, "ava.csv")
    timed(spark, sf_dir).select("video", "h", *[F.lit(0.5).alias(f"b{i}") for i in range(4)], "type", F.lit("0").alias("person")).write.csv(path)
    return src.read_ava(spark, path, keep_unmapped=True).select("video", "start", "end", F.array_join("labels", ",").alias("labels"))


@register("label_studio_import", f"""WITH {TIMED} SELECT video, label, (id % 1000) / 25e0 AS start, (id % 1000 + 50) / 25e0 AS "end" FROM ti WHERE id % 19 <> 0""")
def label_studio_import(spark, sf_dir):
    path = shared_path(spark, "tasks")
    rows = timed(spark, sf_dir)
    first = (F.col("id") % 1000).cast("double")
    value = F.struct(F.array("label").alias("timelinelabels"), F.array(F.struct(first.alias("start"), (first + 50).alias("end"))).alias("ranges"), F.lit(2000).alias("framesCount"))
    result = F.struct((F.col("id") % 19 == 0).alias("was_cancelled"), F.array(F.struct(value.alias("value"))).alias("result"))
    tasks = rows.groupBy("video").agg(F.collect_list(result).alias("annotations"))
    task = F.struct(F.create_map(F.lit("video"), F.col("video")).alias("data"), F.lit(25.0).alias("fps"), "annotations")
    files = tasks.groupBy(F.pmod(F.hash("video"), F.lit(8)).alias("file")).agg(F.to_json(F.collect_list(task)).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    return src.read_label_studio(spark, path).select("video", F.col("labels")[0].alias("label"), "start", "end")


@register(
    "cvat_import",
    f"""WITH {TIMED}, d AS (SELECT DISTINCT video, type, h FROM ti), c AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY video, type ORDER BY h) <= 1 THEN 0 ELSE 1 END AS cut FROM d),
    g AS (SELECT *, sum(cut) OVER (PARTITION BY video, type ORDER BY h) AS g FROM c)
    SELECT video, CASE type WHEN 'view' THEN 'sniffing' ELSE type END AS label, min(h) / 25e0 AS start, (max(h) + 1) / 25e0 AS "end" FROM g GROUP BY video, type, g""",
)
def cvat_import(spark, sf_dir):
    path = shared_path(spark, "cvat")
    tag = F.concat(F.lit('<tag frame="'), F.col("h").cast("string"), F.lit('" label="'), "type", F.lit('"></tag>'))
    head = F.concat(F.lit("<annotations><meta><task><name>"), "video", F.lit("</name><fps>25</fps></task></meta>"))
    files = timed(spark, sf_dir).groupBy("video").agg(F.array_join(F.collect_list(tag), "\n").alias("tags"))
    files.select(F.col("video").alias("export"), F.concat(head, "tags", F.lit("</annotations>")).alias("value")).repartition("export").write.partitionBy("export").text(path)
    return src.read_cvat(spark, path, {"view": "sniffing"}, keep_unmapped=True).select("video", F.col("labels")[0].alias("label"), "start", "end")


@register("corpus_round_trip", """SELECT conv_id, turn, text AS caption, role AS label, length(text) / 8e0 AS duration, turn AS barks, 0.25e0 AS valence FROM conversations""")
def corpus_round_trip(spark, sf_dir):
    path = shared_path(spark, "corpus")
    rows = table(spark, sf_dir, "conversations")
    voice = F.struct(F.create_map(F.lit("bark"), F.col("turn").cast("long")).alias("kinds"), F.lit(0.5).alias("arousal"), F.lit(0.25).alias("valence"), F.lit(0.0).alias("vocal_fraction"))
    dialogues.write_corpus(
        rows.select(
            F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("video"), F.col("text").alias("caption"), F.array("role").alias("labels"), (F.length("text") / 8.0).alias("duration"), F.lit("").alias("group"),
            voice.alias("audio"),
        ), path,
    )
    back, at = dialogues.read_corpus(spark, path), F.split("video", "_")
    kinds = {f.name: f.dataType for f in rows.schema}
    return back.select(
        at[0].cast(kinds["conv_id"]).alias("conv_id"), at[1].cast(kinds["turn"]).alias("turn"), "caption", F.col("labels")[0].alias("label"), "duration", F.col("audio.kinds")["bark"].cast(kinds["turn"]).alias("barks"), "audio.valence"
    )


TURNS = "qa AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS a FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"


def turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")).join(answers, ["conv_id", "turn"])


@register("dialogue_round_trip", f"WITH {TURNS} SELECT q AS question, a AS answer, 'i' || (conv_id % 5) AS intent, 'sitting' AS behaviour, 'growl' AS voice, 0.5e0 AS arousal, -0.25e0 AS valence FROM qa")
def dialogue_round_trip(spark, sf_dir):
    path = shared_path(spark, "dialogues")
    rows = turns(spark, sf_dir).select(
        F.col("q").alias("question"), F.col("a").alias("answer"), F.concat(F.lit("i"), (F.col("conv_id") % 5).cast("string")).alias("intent"), F.lit("sitting").alias("behaviour"), F.lit("growl").alias("voice"), F.lit(0.5).alias("arousal"),
        F.lit(-0.25).alias("valence"),
    )
    dialogues.write_dialogues(rows, path)
    return dialogues.read_dialogues(spark, path)


PATTERN = "'[a-z0-9'']+|[.,!?;]'"


@register(
    "question_answer_pairs",
    f"""WITH {TURNS}, l AS (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(q), {PATTERN}), lambda x: length(x) + 10) AS q, list_transform(regexp_extract_all(lower(a), {PATTERN}), lambda x: length(x) + 10) AS a FROM qa),
    w AS (SELECT conv_id, turn, list_slice(list_concat(list_concat([1], q), list_concat([4], list_concat(a, [2]))), 1, 25) AS w FROM l),
    p AS (SELECT conv_id, turn, list_slice(w, 1, len(w) - 1) AS i, list_slice(w, 2, len(w)) AS t FROM w),
    m AS (SELECT *, CASE WHEN list_contains(i, 4) THEN list_position(i, 4) - 1 ELSE 0 END AS cut FROM p)
    SELECT conv_id, turn, CAST(list_sum(i) AS BIGINT) AS input_sum, CAST(coalesce(list_sum(list_slice(t, cut + 1, len(t))), 0) AS BIGINT) AS target_sum, 24 AS n FROM m""",
)
def question_answer_pairs(spark, sf_dir):
    ids = lambda c: F.transform(text.tokens(F.col(c)), lambda t: (F.length(t) + 10).cast("long"))
    pairs = turns(spark, sf_dir).select("conv_id", "turn", text.question_answer(ids("q"), ids("a"), 24, 4).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return pairs.select("conv_id", "turn", total("p.input").alias("input_sum"), total("p.target").alias("target_sum"), F.size("p.input").alias("n"))


CLASSED = f"""{WINDOWS}, cl AS (SELECT video, 'active' AS class, w, t0, t1, score FROM wi UNION ALL SELECT video, 'calm', w, t0, t1, 1e0 - score FROM wi)"""
SMOOTHED = f"""{CLASSED}, sm AS (SELECT video, class, w, t0, t1, list_sort([coalesce(lag(score) OVER o, score), score, coalesce(lead(score) OVER o, score)])[2] AS score FROM cl WINDOW o AS (PARTITION BY video, class ORDER BY w)),
g AS (SELECT *, w - row_number() OVER (PARTITION BY video, class ORDER BY w) AS g FROM sm WHERE score >= 0.5e0),
ru AS (SELECT video, class, min(t0) AS start, max(t1) AS "end", avg(score) AS score, max(score) AS peak FROM g GROUP BY video, class, g),
c AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY video, class ORDER BY start) <= 0.25e0 THEN 0 ELSE 1 END AS cut FROM ru),
i AS (SELECT *, sum(cut) OVER (PARTITION BY video, class ORDER BY start) AS k FROM c),
l AS (SELECT video, class, k, list({{'s': start, 'e': "end", 'q': score, 'p': peak}} ORDER BY start) AS x FROM i GROUP BY video, class, k),
m AS (SELECT video, class, list_reduce(x, lambda a, b: {{'s': a.s, 'e': b.e, 'q': (a.q * (a.e - a.s) + b.q * (b.e - b.s)) / ((a.e - a.s) + (b.e - b.s)), 'p': greatest(a.p, b.p)}}) AS r FROM l)"""


def class_scores(spark, sf_dir):
    rows = windows(spark, sf_dir).select("video", "w", "t0", "t1", "score")
    return rows.withColumn("class", F.lit("active")).unionByName(rows.withColumn("score", 1.0 - F.col("score")).withColumn("class", F.lit("calm")))


@register(
    "predicted_spans",
    f"""WITH {SMOOTHED} SELECT video, class AS behaviour, r.s AS start, r.e AS "end", round(r.q, 9) AS score, round(r.p, 9) AS peak FROM m WHERE r.e - r.s >= 1.25e0""",
)
def predicted_spans(spark, sf_dir):
    found = predict.predict_spans(class_scores(spark, sf_dir), None, Inference(min_duration=1.25))
    return found.select("video", "behaviour", "start", "end", F.round("score", 9).alias("score"), F.round("peak", 9).alias("peak"))


@register(
    "explained_windows",
    f"""WITH {CLASSED}, pr AS (SELECT DISTINCT video, p * 3.3e0 AS "at" FROM wi, range(0, 5) r(p)), n AS (SELECT pr.video, "at", w, row_number() OVER (PARTITION BY pr.video, "at" ORDER BY abs((t0 + t1) / 2e0 - "at"), w) AS k FROM pr JOIN wi ON pr.video = wi.video)
    SELECT n.video, "at", class, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY n.video, "at" ORDER BY score DESC, class) AS INT) AS rank FROM n JOIN cl ON n.video = cl.video AND n.w = cl.w WHERE k = 1""",
)
def explained_windows(spark, sf_dir):
    scores = class_scores(spark, sf_dir)
    probes = scores.select("video").distinct().withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("video", (F.col("p") * F.lit(3.3)).alias("at"))
    return predict.explain(scores, probes, 2).withColumn("score", F.round("score", 9))


FLAGS = ", ".join(f"'{x}'" for x in AROUSAL_FLAGS)


@register(
    "video_reports",
    f"""WITH {SPANS}, {TOTALS}, t AS (SELECT video, behaviour, sum("end" - start) AS s FROM ev GROUP BY ALL), d AS (SELECT video, behaviour AS dominant FROM t QUALIFY row_number() OVER (PARTITION BY video ORDER BY s DESC, behaviour) = 1),
    n AS (SELECT video, count(*) AS n_spans, count(DISTINCT behaviour) AS n_behaviours FROM ev GROUP BY video), f AS (SELECT video, sum("end" - start) AS s FROM ev WHERE behaviour IN ({FLAGS}) GROUP BY video)
    SELECT video, n_spans, n_behaviours, dominant, round(least(1e0, coalesce(s, 0e0) / duration), 9) AS arousal_fraction FROM tot JOIN n USING (video) JOIN d USING (video) LEFT JOIN f USING (video)""",
)
def video_reports(spark, sf_dir):
    rows = spans(spark, sf_dir).select("video", "behaviour", "start", "end", "score", F.col("score").alias("peak"))
    out = predict.reports(rows, totals(spark, sf_dir), len(BEHAVIOUR_OF))
    return out.select("video", F.size("spans").cast("long").alias("n_spans"), F.size("time_per_behaviour").cast("long").alias("n_behaviours"), "dominant", F.round("arousal_fraction", 9).alias("arousal_fraction"))


@register(
    "resolved_videos",
    """WITH u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN '/up/1/x7-u' || user_id || '.mp4' WHEN 1 THEN 'u' || user_id ELSE 'lost' || user_id END AS name FROM u)
    SELECT name, CASE WHEN user_id % 2 = 0 AND user_id % 3 < 2 THEN '/data/' || (user_id % 5) || '/u' || user_id || '.mp4' ELSE name END AS path FROM n""",
)
def resolved_videos(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    name = F.when(u % 3 == 0, F.concat(F.lit("/up/1/x7-u"), u, F.lit(".mp4"))).when(u % 3 == 1, F.concat(F.lit("u"), u)).otherwise(F.concat(F.lit("lost"), u))
    files = users.where("user_id % 2 = 0").select(F.concat(F.lit("/data/"), u % 5, F.lit("/u"), u, F.lit(".mp4")).alias("path"))
    return src.resolve_videos(users.select(name.alias("name")), files)


@register("telling_events", f"""WITH {SPANS}, r AS (SELECT video, id, row_number() OVER (PARTITION BY video ORDER BY "end" - start DESC, start) AS k FROM ev) SELECT video, id FROM r WHERE k <= 4""")
def telling_events(spark, sf_dir):
    return rules.most_telling(spans(spark, sf_dir), ["video"], 4).select("video", "id")


@register("voice_counts", f"WITH {VOICED} SELECT video, round(ln(1e0 + count(*) FILTER (kind = 'growl')) / 3e0, 9) AS growl, round(ln(1e0 + count(*) FILTER (kind = 'whine')) / 3e0, 9) AS whine FROM vt GROUP BY video")
def voice_counts(spark, sf_dir):
    events = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark))
    counts = events.groupBy("video", "kind").agg(F.count("*").cast("int").alias("n")).groupBy("video").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    vector = counts.select("video", rules.voice_counts_vector(F.col("kinds")).alias("v"))
    from spanloom.schema import VOICE_KINDS

    return vector.select("video", *[F.round(F.get("v", F.lit(VOICE_KINDS.index(k))), 9).alias(k) for k in ("growl", "whine")])


@register(
    "decode_sizes",
    """WITH s AS (SELECT o_orderkey AS id, 64 + o_orderkey % 1900 AS w, 48 + o_custkey % 1100 AS h FROM orders), f AS (SELECT *, least(1e0, 144e0 / least(w, h)) AS f FROM s)
    SELECT id, CAST(greatest(2, floor(w * f / 2e0) * 2) AS INT) AS width, CAST(greatest(2, floor(h * f / 2e0) * 2) AS INT) AS height FROM f""",
)
def decode_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), numbers.decode_size(64 + F.col("o_orderkey") % 1900, 48 + F.col("o_custkey") % 1100, 144).alias("s"))
    return rows.select("id", "s.width", "s.height")


@register(
    "learning_rates",
    """SELECT event_id AS step, round(CASE WHEN event_id < 100 THEN 0.5e0 * (event_id + 1) / 100e0 ELSE 0.01e0 + 0.5e0 * 0.49e0 * (1 + cos(pi() * least(1e0, (event_id - 100) / 4900e0))) END, 9) AS rate FROM events""",
)
def learning_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.round(numbers.cosine_rate(F.col("event_id"), 5000, 100, 0.5, 0.01), 9).alias("rate"))


@register("window_hops", """SELECT o_orderkey AS id, CAST(greatest(1, round_even((8 + o_orderkey % 57) * greatest(0.05e0, (o_custkey % 11) / 8e0), 0)) AS INT) AS hop FROM orders""")
def window_hops(spark, sf_dir):
    from spanloom.operators.spans import window_hop

    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), window_hop(8 + F.col("o_orderkey") % 57, (F.col("o_custkey") % 11) / 8.0).alias("hop"))


FILES = "fi AS (SELECT page_id AS id, url AS path, page_id % 97 AS modified, length(html) AS length FROM pages)"


def files(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), (F.col("page_id") % 97).alias("modified"), F.length("html").alias("length"))


@register("stale_media", f"WITH {FILES} SELECT id FROM fi WHERE path IS NULL OR length IS NULL OR id % 3 = 0 OR id % 5 = 0")
def stale_media(spark, sf_dir):
    rows = files(spark, sf_dir).dropDuplicates(["path", "modified", "length"])
    known = rows.where("id % 3 <> 0").withColumn("length", F.when(F.col("id") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return md.stale(rows, known).select("id")


@register(
    "requested_frames",
    f"""WITH {TIMED}, fr AS (SELECT video, h % 40 AS frame, min(id) AS pixel FROM ti GROUP BY ALL), la AS (SELECT video, max(frame) AS last FROM fr GROUP BY video),
    rq AS (SELECT video, last, unnest(range(0, 12)) AS position FROM la) SELECT rq.video, CAST(position AS INT) AS position, fr.frame, pixel FROM rq JOIN fr ON rq.video = fr.video AND fr.frame = least(last, position * 5)""",
)
def requested_frames(spark, sf_dir):
    frames = timed(spark, sf_dir).groupBy("video", (F.col("h") % 40).alias("frame")).agg(F.min("id").alias("pixel"))
    asked = frames.select("video").distinct().withColumn("frames", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: i * 5))
    return md.frames_at(asked, frames).select("video", "position", "frame", "pixel")


@register("audio_index", f"WITH {VOICED} SELECT id, CASE WHEN id % 3 = 0 THEN 'late' ELSE 'early' END AS part, kind FROM vt")
def audio_index(spark, sf_dir):
    events = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark)).select("id", "kind")
    early, late = events.withColumn("part", F.lit("early")), events.where("id % 3 = 0").withColumn("part", F.lit("late"))
    return md.audio_index([early, late], "id").select("id", "part", "kind")


def _of_split(condition: str) -> str:
    return AUDIT.replace("FROM events)", f"FROM events WHERE {condition})")


@register(
    "split_audit",
    f"""SELECT 'val' AS split, * FROM (WITH {_of_split('event_id % 5 = 0')} SELECT level, code, subject, count(*) AS n FROM fi GROUP BY ALL)
    UNION ALL SELECT 'train', * FROM (WITH {_of_split('event_id % 5 <> 0')} SELECT level, code, subject, count(*) AS n FROM fi GROUP BY ALL)
    UNION ALL SELECT NULL, 'error', 'split_leakage', CAST(user_id AS VARCHAR), 1 FROM events GROUP BY user_id HAVING count(DISTINCT event_id % 5 = 0) > 1""",
)
def split_audit(spark, sf_dir):
    rows = annotations(spark, sf_dir).withColumn("split", F.when(F.col("id") % 5 == 0, "val").otherwise("train"))
    found = audit.audit_splits(rows, media(spark, sf_dir), label_dim(spark, AUDITED), clip_seconds=60.0, min_examples=2000)
    return found.groupBy("split", "level", "code", "subject").agg(F.count("*").alias("n"))


@register(
    "corpus_examples",
    f"""WITH {SPANS} SELECT id, round(CASE WHEN behaviour IN ('sitting', 'running', 'playing', 'barking') THEN 1e0 ELSE 0e0 END + ln(1e0 + id % 4) / 3e0 + 0.5e0 - 0.25e0 + 0.125e0 + ln(1e0 + greatest(0e0, "end" - start)) / 4e0, 6) AS total, 16 AS n FROM ev""",
)
def corpus_examples(spark, sf_dir):
    voice = F.struct(F.create_map(F.lit("growl"), (F.col("id") % 4).cast("long")).alias("kinds"), F.lit(0.5).alias("arousal"), F.lit(-0.25).alias("valence"), F.lit(0.125).alias("vocal_fraction"))
    corpus = spans(spark, sf_dir).select(F.col("id").alias("video"), F.array("behaviour").alias("labels"), (F.col("end") - F.col("start")).alias("duration"), voice.alias("audio"), F.lit("").alias("caption"))
    rows = text.corpus_to_examples(corpus, ["sitting", "running", "playing", "barking"])
    total = F.aggregate("condition", F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("video").alias("id"), F.round(total, 6).alias("total"), F.size("condition").alias("n"))


STATES = """st AS (SELECT event_id AS video, CASE event_id % 3 WHEN 0 THEN 'sitting' WHEN 1 THEN 'running' END AS behaviour, CASE WHEN event_id % 4 = 0 THEN 'growl' END AS voice,
  (event_id % 5) / 8e0 AS a1, (event_id % 7) / 8e0 - 0.5e0 AS v1, 0.75e0 AS a2, CASE WHEN event_id % 2 = 0 THEN 0.25e0 END AS v2 FROM events)"""


@register(
    "dialogue_states",
    f"""WITH {STATES}, s AS (SELECT video, coalesce(behaviour, 'standing') AS behaviour, coalesce(voice, '') AS voice, coalesce(nullif(a1, 0e0), a2, 0e0) AS arousal, coalesce(nullif(v1, 0e0), v2, 0e0) AS valence FROM st)
    SELECT *, round(CASE WHEN behaviour IN ('sitting', 'running') THEN 1e0 ELSE 0.15e0 END + CASE WHEN voice <> '' THEN 1e0 ELSE 0e0 END + arousal + valence, 9) AS total, 12 AS n FROM s""",
)
def dialogue_states(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        e.alias("video"), F.when(e % 3 == 0, "sitting").when(e % 3 == 1, "running").alias("behaviour"), F.when(e % 4 == 0, "growl").alias("voice"), ((e % 5) / 8.0).alias("affect_arousal"),
        ((e % 7) / 8.0 - 0.5).alias("affect_valence"), F.lit(0.75).alias("audio_arousal"), F.when(e % 2 == 0, 0.25).alias("audio_valence"),
    )
    states = rules.state_of(rows, ["video"])
    vector = rules.state_vector(F.col("behaviour"), F.col("voice"), F.col("arousal"), F.col("valence"), ["sitting", "running"])
    return states.withColumn("v", vector).select(*states.columns, F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), F.size("v").alias("n"))


LINES = {"sitting": ["I wait.", "Any minute now."], "running": ["Fast!", "Faster!", "This is what legs are for."], "sniffing": ["What was here?"]}
SOUNDS = {"growl": ["Close enough.", "Stop."], "yelp": ["Ow!"], "whine": ["Please.", "Help me."], "bark": ["Hey."]}
MOODS = {(a, v): [f"{a} {v} one", f"{a} {v} two"] for a in ("low", "medium", "high") for v in ("negative", "neutral", "positive")}


@register("translation")
def translation(spark, sf_dir):
    events = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark)).withColumn("start", F.col("id") * 10.0).withColumn("end", F.col("start") + F.col("seconds"))
    told = rules.translate(
        spans(spark, sf_dir).select("video", "behaviour", "start", "end", "score"), events.select(F.col("video").cast("long").alias("video"), "kind", "start", "end", "f0", "confidence", "concerning"), blended(spark, sf_dir), ["video"],
        spark.createDataFrame(list(LINES.items()), "behaviour string, lines array<string>"), spark.createDataFrame(list(SOUNDS.items()), "kind string, lines array<string>"),
        spark.createDataFrame([(*k, v) for k, v in MOODS.items()], "arousal_band string, valence_band string, lines array<string>"),
    )
    return told.select("video", "headline", F.size("utterances").alias("n"), F.get("utterances", F.lit(0))["text"].alias("first"), "urgent", "heard", "saw", "notes")


@register("dataset_catalogue", "SELECT * FROM (VALUES ('animalkingdom', 15.1e0, 0), ('dog-behavior', 9.5e0, 5), ('mammalnet', 159e0, 0)) t(key, gigabytes, n_behaviours)")
def dataset_catalogue(spark, sf_dir):
    return catalogue.catalogue(spark).select("key", "gigabytes", F.size("behaviours").alias("n_behaviours"))
