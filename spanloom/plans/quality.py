"""Queries on audits, duplicates, splits, samplers and rule aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import audit, dedup, rules, splits
from spanloom.plans.bindings import BEHAVIOUR_OF, SPANS, TOTALS, spans, table, totals
from spanloom.plans.registry import register
from spanloom.schema import AFFECT, POSTURES, VOICE, affect_dim, label_dim, voice_dim

AUDITED = ["sitting", "standing", "running", "playing", "sniffing", "yawning"]
LABELS = ", ".join(f"'{x}'" for x in AUDITED)
PLIST = ", ".join(f"'{x}'" for x in POSTURES)


def media(spark, sf_dir):
    """Users as videos of a length that cuts some spans, with low rates and small frames for some; some users have none."""
    users = spans(spark, sf_dir).select("video").distinct().where("video % 17 <> 3")
    return users.select("video", (2400000.0 + F.col("video") * 100.0).alias("duration"), F.when(F.col("video") % 11 == 0, 8.0).otherwise(25.0).alias("fps"), F.lit(640).alias("width"), F.when(F.col("video") % 13 == 0, 96).otherwise(480).alias("height"))


def annotations(spark, sf_dir):
    rows = spans(spark, sf_dir)
    labels = F.when(F.col("id") % 29 == 0, F.array().cast("array<string>")).otherwise(F.array("behaviour"))
    return rows.select("id", "video", labels.alias("labels"), F.when(F.col("id") % 31 == 0, F.col("start") - 1e7).otherwise(F.col("start")).alias("start"), F.when(F.col("id") % 37 == 0, F.lit(None)).when(F.col("id") % 41 == 0, F.col("start") - 5).otherwise(F.col("end")).alias("end"), F.col("video").cast("string").alias("group"))


AUDIT = f"""{SPANS}, me AS (SELECT DISTINCT video, 2400000e0 + video * 100e0 AS duration, CASE WHEN video % 11 = 0 THEN 8e0 ELSE 25e0 END AS fps, 640 AS width, CASE WHEN video % 13 = 0 THEN 96 ELSE 480 END AS height FROM ev WHERE video % 17 <> 3),
an AS (SELECT id, video, CASE WHEN id % 29 = 0 THEN NULL ELSE behaviour END AS lab, CASE WHEN id % 31 = 0 THEN start - 1e7 ELSE start END AS start, CASE WHEN id % 37 = 0 THEN NULL WHEN id % 41 = 0 THEN start - 5 ELSE "end" END AS "end" FROM ev),
ck AS (SELECT an.*, duration, fps, width, height, coalesce("end", duration) AS stop FROM an LEFT JOIN me USING (video)),
pr AS (SELECT * FROM ck WHERE duration IS NOT NULL), us AS (SELECT *, least(stop, duration) - start AS seconds FROM pr WHERE NOT (stop <= start OR start >= duration)),
cn AS (SELECT lab AS name, count(*) AS n FROM us WHERE lab IS NOT NULL GROUP BY lab), ls AS (SELECT unnest([{LABELS}]) AS name),
fi AS (SELECT 'error' AS level, 'missing_file' AS code, CAST(video AS VARCHAR) AS subject FROM ck WHERE duration IS NULL
 UNION ALL SELECT 'info', 'negative', CAST(video AS VARCHAR) FROM pr WHERE lab IS NULL
 UNION ALL SELECT 'error', 'bad_span', CAST(video AS VARCHAR) FROM pr WHERE start < 0 UNION ALL SELECT 'error', 'bad_span', CAST(video AS VARCHAR) FROM pr WHERE stop <= start
 UNION ALL SELECT 'error', 'bad_span', CAST(video AS VARCHAR) FROM pr WHERE stop > start AND start >= duration
 UNION ALL SELECT 'warning', 'span_overrun', CAST(video AS VARCHAR) FROM us WHERE stop > duration + 0.05e0
 UNION ALL SELECT 'warning', 'span_too_short', coalesce(lab, '') FROM us WHERE seconds < 60
 UNION ALL SELECT 'warning', 'low_fps', CAST(video AS VARCHAR) FROM us WHERE fps < 10 UNION ALL SELECT 'warning', 'low_resolution', CAST(video AS VARCHAR) FROM us WHERE least(width, height) < 128
 UNION ALL SELECT 'error', 'unknown_label', CAST(video AS VARCHAR) FROM pr WHERE lab IS NOT NULL AND lab NOT IN ({LABELS})
 UNION ALL SELECT 'warning', 'no_examples', ls.name FROM ls LEFT JOIN cn USING (name) WHERE n IS NULL UNION ALL SELECT 'warning', 'few_examples', name FROM ls JOIN cn USING (name) WHERE n < 2000
 UNION ALL SELECT 'warning', 'imbalance', '' FROM (SELECT max(n) / greatest(1, min(n)) AS r FROM cn) WHERE r > 50
 UNION ALL SELECT 'warning', 'contradiction', CAST(a.video AS VARCHAR) FROM us a JOIN us b ON a.video = b.video AND a.id < b.id AND a.start < b.stop AND b.start < a.stop AND a.lab IN ({PLIST}) AND b.lab IN ({PLIST}) AND a.lab <> b.lab)"""


def findings(spark, sf_dir):
    return audit.audit_annotations(annotations(spark, sf_dir), media(spark, sf_dir), label_dim(spark, AUDITED), clip_seconds=60.0, min_examples=2000)


@register("audit_findings", f"WITH {AUDIT} SELECT level, code, subject, count(*) AS n FROM fi GROUP BY ALL")
def audit_findings(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("level", "code", "subject").agg(F.count("*").alias("n"))


@register("audit_totals", f"""WITH {AUDIT} SELECT lab AS label, count(*) AS n, round(sum(seconds), 3) AS seconds FROM us WHERE lab IS NOT NULL GROUP BY lab""")
def audit_totals(spark, sf_dir):
    usable = audit.checked(annotations(spark, sf_dir), media(spark, sf_dir)).where("reason IS NULL")
    return audit.totals(usable).withColumn("seconds", F.round("seconds", 3))


@register("skip_with_reason", f"""WITH {AUDIT} SELECT CASE WHEN duration IS NULL THEN 'missing_file' WHEN stop <= start OR start >= duration THEN 'bad_span' ELSE 'usable' END AS reason, count(*) AS n FROM ck GROUP BY ALL""")
def skip_with_reason(spark, sf_dir):
    rows = audit.checked(annotations(spark, sf_dir), media(spark, sf_dir))
    return rows.groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@register(
    "contradiction_pairs",
    f"""WITH {SPANS} SELECT a.video, a.id AS a_id, b.id AS b_id FROM ev a JOIN ev b ON a.video = b.video AND a.id < b.id AND a.start < b."end" AND b.start < a."end" AND a.behaviour <> b.behaviour
    WHERE a.behaviour IN ({PLIST}) AND b.behaviour IN ({PLIST})""",
)
def contradiction_pairs(spark, sf_dir):
    from spanloom.operators.spans import overlapping_pairs

    rows = spans(spark, sf_dir).where(F.col("behaviour").isin(POSTURES)).select("video", "id", "start", "end", "behaviour")
    return overlapping_pairs(rows, ["video"], "id", 3600.0).where("a_behaviour <> b_behaviour").select("video", "a_id", "b_id")


@register("label_counts", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'none', 0")
def label_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.array("o_orderpriority").alias("labels"))
    return splits.label_counts(rows, "labels", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"])


@register("imbalance_ratio", "SELECT CAST(max(n) AS DOUBLE) / greatest(1, min(n)) AS imbalance_ratio FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)")
def imbalance_ratio(spark, sf_dir):
    return audit.imbalance_ratio(splits.label_counts(table(spark, sf_dir, "orders").select(F.array("o_orderpriority").alias("labels")), "labels"))


@register(
    "split_leakage",
    """WITH s AS (SELECT DISTINCT o_custkey AS "group", CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM orders)
    SELECT "group", array_to_string(list(split ORDER BY split), ',') AS splits FROM s GROUP BY "group" HAVING count(*) > 1""",
)
def split_leakage(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"))
    return audit.split_leakage(rows).select("group", F.array_join("splits", ",").alias("splits"))


BITS = """vb AS (SELECT vec_id AS id, list_transform(range(2, 65), lambda i: CASE WHEN embedding[i] > embedding[i - 1] THEN 1 ELSE 0 END) AS bits FROM embeddings),
sg AS (SELECT id, CAST(list_reduce(list_transform(bits, lambda b: CAST(b AS HUGEINT)), lambda a, b: a * 2 + b) AS BIGINT) AS w FROM vb)"""


def signatures(spark, sf_dir):
    bits = dedup.difference_bits(F.col("embedding"), 64)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), dedup.pack_bits(bits, 63).alias("words"))


@register("dhash_bits", f"WITH {BITS} SELECT id, CAST(bit_count(w) AS INT) AS ones, w AS word FROM sg")
def dhash_bits(spark, sf_dir):
    return signatures(spark, sf_dir).select("id", F.bit_count(F.col("words")[0]).alias("ones"), F.shiftrightunsigned(F.col("words")[0], 1).alias("word"))


COPIES = 1000000


def clips(spark, sf_dir):
    """Vectors as clips of eight frames of 64 difference bits, and an edited copy of every second one: id, words."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    edited = F.transform("e", lambda x, i: F.when(i == F.col("id") % 64, -x).otherwise(x))
    both = rows.unionByName(rows.where("id % 2 = 0").select((F.col("id") + COPIES).alias("id"), edited.alias("e")))
    frame = lambda k: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.get("e", (i + k) % 64) > F.get("e", i)).cast("int"))
    return both.select("id", dedup.pack_bits(F.concat(*[frame(k) for k in range(1, 9)]), 512).alias("words"))


PAIRS = f"""cv AS (SELECT vec_id AS id, embedding AS e FROM embeddings UNION ALL
  SELECT vec_id + {COPIES}, list_transform(range(1, 65), lambda i: CASE WHEN i = vec_id % 64 + 1 THEN -embedding[i] ELSE embedding[i] END) FROM embeddings WHERE vec_id % 2 = 0),
fr AS (SELECT id, k, list_reduce(list_transform(range(0, 64), lambda i: CAST(CASE WHEN e[(i + k) % 64 + 1] > e[i + 1] THEN 1 ELSE 0 END AS HUGEINT)), lambda a, b: a * 2 + b) AS h FROM cv, range(1, 9) t(k)),
sg AS (SELECT id, list(CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) ORDER BY k) AS w FROM fr GROUP BY id),
ap AS (SELECT a.id AS a, b.id AS b, CAST(list_sum(list_transform(range(1, 9), lambda i: bit_count(xor(a.w[i], b.w[i])))) AS INT) AS distance FROM sg a JOIN sg b ON a.id < b.id)"""


@register("signature_distances", f"WITH {PAIRS} SELECT a AS id, distance FROM ap WHERE b = a + {COPIES}")
def signature_distances(spark, sf_dir):
    rows = clips(spark, sf_dir)
    edited = rows.where(F.col("id") >= COPIES).select((F.col("id") - COPIES).alias("id"), F.col("words").alias("other"))
    return rows.join(edited, "id").select("id", dedup.hamming(F.col("words"), F.col("other")).alias("distance"))


def classes_sql(distance: int) -> str:
    return f"""{PAIRS}, np AS (SELECT a, b FROM ap WHERE distance <= {distance}), e AS (SELECT a, b FROM np UNION SELECT b, a FROM np),
    r AS (SELECT id AS x, id AS y FROM sg UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a), cl AS (SELECT x AS id, min(y) AS class_id FROM r GROUP BY x),
    nl AS (SELECT a AS id, count(*) AS n FROM e GROUP BY a)"""


CLASSES = "SELECT cl.id, class_id, coalesce(n, 0) AS n_links FROM cl LEFT JOIN nl ON cl.id = nl.id"


@register("near_duplicate_classes_d6", f"WITH RECURSIVE {classes_sql(6)} {CLASSES}")
def near_duplicate_classes_d6(spark, sf_dir):
    return dedup.near_classes(clips(spark, sf_dir), "id", "words", 512, 6)


@register("near_duplicate_classes_d16", f"WITH RECURSIVE {classes_sql(16)} {CLASSES}")
def near_duplicate_classes_d16(spark, sf_dir):
    return dedup.near_classes(clips(spark, sf_dir), "id", "words", 512, 16)


@register("duplicate_components", f"""WITH RECURSIVE {classes_sql(16)} SELECT id AS "group", class_id AS canonical FROM cl""")
def duplicate_components(spark, sf_dir):
    rows = clips(spark, sf_dir).select("id", F.col("id").alias("grp"), "words")
    return dedup.merge_duplicate_groups(rows, "grp", "id", "words", 512, 16)


@register(
    "cross_split_duplicates",
    f"""WITH RECURSIVE {classes_sql(16)} SELECT class_id, count(*) AS n, string_agg(DISTINCT CASE WHEN id % 3 = 0 THEN 'val' ELSE 'train' END, ',' ORDER BY CASE WHEN id % 3 = 0 THEN 'val' ELSE 'train' END) AS splits
    FROM cl GROUP BY class_id HAVING count(DISTINCT id % 3 = 0) > 1""",
)
def cross_split_duplicates(spark, sf_dir):
    rows = clips(spark, sf_dir)
    owners = rows.select("id", F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"))
    found = audit.cross_split_duplicates(dedup.near_classes(rows, "id", "words", 512, 16), owners)
    return found.select("class_id", "n", F.array_join("splits", ",").alias("splits"))


@register("text_exact_duplicates", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def text_exact_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def unit_sql(*columns: str) -> str:
    """splits.unit in SQL."""
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', {', '.join(columns)})), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496e0)"


@register(
    "make_splits",
    f"""WITH pl AS (SELECT o_custkey AS g, o_orderpriority AS label FROM orders), t AS (SELECT label, count(*) AS m FROM pl GROUP BY label),
    s AS (SELECT g, count(*) AS n, {unit_sql('g', '0')} AS u FROM pl GROUP BY g), r AS (SELECT g, label FROM pl JOIN t USING (label) QUALIFY row_number() OVER (PARTITION BY g ORDER BY m, label) = 1),
    p AS (SELECT g, (sum(n) OVER (PARTITION BY label ORDER BY u, g ROWS UNBOUNDED PRECEDING) - n / 2e0) / sum(n) OVER (PARTITION BY label) AS mid FROM s JOIN r USING (g))
    SELECT g AS "group", CASE WHEN mid < 0.7e0 THEN 'train' WHEN mid < 0.7e0 + 0.2e0 THEN 'val' ELSE 'test' END AS split FROM p""",
)
def make_splits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.array("o_orderpriority").alias("labels"))
    return splits.make_splits(rows, "grp", "labels", {"train": 70, "val": 20, "test": 10})


@register(
    "repeat_factors",
    """WITH l AS (SELECT event_id AS id, CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN NULL ELSE event_type END AS label FROM events),
    f AS (SELECT label, greatest(1e0, least(8e0, sqrt(0.5e0 / (count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM l))))) AS f FROM l WHERE label IS NOT NULL GROUP BY label)
    SELECT id, round(coalesce(f, 1e0), 9) AS factor FROM l LEFT JOIN f USING (label)""",
)
def repeat_factors(spark, sf_dir):
    return splits.repeat_factors(some_labels(spark, sf_dir), "id", "labels", 0.5).withColumn("factor", F.round("factor", 9))


def some_labels(spark, sf_dir):
    unlabelled = (F.col("event_type") == "view") & (F.col("event_id") % 7 != 0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(unlabelled, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("labels"))


@register(
    "class_balanced_weights",
    """WITH l AS (SELECT event_id AS id, CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN NULL ELSE event_type END AS label FROM events),
    c AS (SELECT label, 1e0 / count(*) AS w FROM l WHERE label IS NOT NULL GROUP BY label), r AS (SELECT id, coalesce(w, 1e0) AS raw FROM l LEFT JOIN c USING (label))
    SELECT id, round(raw / (SELECT sum(raw) FROM r), 12) AS weight FROM r""",
)
def class_balanced_weights(spark, sf_dir):
    return splits.class_balanced_weights(some_labels(spark, sf_dir), "id", "labels").withColumn("weight", F.round("weight", 12))


FACTORS = """l AS (SELECT event_id AS id, CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN NULL ELSE event_type END AS label FROM events),
f AS (SELECT label, greatest(1e0, least(8e0, sqrt(0.5e0 / (count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM l))))) AS f FROM l WHERE label IS NOT NULL GROUP BY label),
rf AS (SELECT id, coalesce(f, 1e0) AS factor FROM l LEFT JOIN f USING (label))"""


@register("repeat_draws", f"WITH {FACTORS} SELECT id, CAST(unnest(range(1, CAST(floor(factor) AS BIGINT) + CASE WHEN {unit_sql('id', '1', '0')} < factor - floor(factor) THEN 1 ELSE 0 END + 1)) AS BIGINT) AS copy FROM rf")
def repeat_draws(spark, sf_dir):
    return splits.draw_repeats(splits.repeat_factors(some_labels(spark, sf_dir), "id", "labels", 0.5), seed=1)


@register(
    "weighted_draws",
    f"""WITH l AS (SELECT event_id AS id, CASE WHEN event_type = 'view' AND event_id % 7 <> 0 THEN NULL ELSE event_type END AS label FROM events), c AS (SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY label),
    r AS (SELECT id, coalesce(1e0 / n, 1e0) AS raw FROM l LEFT JOIN c USING (label)), w AS (SELECT id, raw / (SELECT sum(raw) FROM r) AS weight, floor({unit_sql('id')} * 1024) AS b FROM r),
    x AS (SELECT id, sum(weight) OVER (ORDER BY b, id ROWS UNBOUNDED PRECEDING) - weight AS low FROM w), d AS (SELECT i AS draw, {unit_sql('i', '1')} AS u FROM range(0, 2000) t(i))
    SELECT CAST(draw AS BIGINT) AS draw, id FROM d ASOF JOIN x ON u >= low""",
)
def weighted_draws(spark, sf_dir):
    return splits.draw_weighted(splits.class_balanced_weights(some_labels(spark, sf_dir), "id", "labels"), 2000, seed=1)


AFFECT_SQL = "af(behaviour, va, ar, w, stress) AS (VALUES " + ", ".join(f"('{b}', {v}e0, {a}e0, {w}e0, {str(s).lower()})" for b, v, a, w, s in AFFECT) + ")"
QUADRANT = """CASE WHEN coverage < 0.15e0 THEN 'not enough to say' WHEN arousal >= 0.6e0 THEN CASE WHEN valence >= 0.25e0 THEN CASE WHEN abs(valence) > 0.3e0 THEN 'excited and enjoying it' ELSE 'excited' END
 WHEN valence <= -0.2e0 THEN 'agitated or stressed' ELSE 'highly activated, valence unclear' END WHEN arousal <= 0.3e0 THEN CASE WHEN valence >= 0.2e0 THEN 'relaxed and content' WHEN valence <= -0.2e0 THEN 'withdrawn or uncomfortable'
 ELSE 'quiet and settled' END WHEN valence >= 0.25e0 THEN 'comfortable and engaged' WHEN valence <= -0.2e0 THEN 'uneasy' ELSE 'neutral' END"""
READ = f"""{SPANS}, {TOTALS}, {AFFECT_SQL},
x AS (SELECT video, behaviour, stress, "end" - start AS d, ("end" - start) * score * w AS wt, va, ar FROM ev JOIN af USING (behaviour) WHERE score >= 0.5e0),
g AS (SELECT video, sum(va * wt) AS v, sum(ar * wt) AS a, sum(wt) AS t, sum(d) AS covered, count(DISTINCT behaviour) AS ne, count(DISTINCT CASE WHEN stress THEN behaviour END) AS ns FROM x WHERE wt > 0 GROUP BY video),
rd AS (SELECT video, duration, CASE WHEN t IS NULL THEN 0e0 ELSE greatest(-1e0, least(1e0, v / t)) END AS valence, CASE WHEN t IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, a / t)) END AS arousal,
  coalesce(least(1e0, covered / (duration / 20e0)), 0e0) AS coverage, coalesce(ne, 0) AS n_evidence, coalesce(ns, 0) AS n_stress, t FROM tot LEFT JOIN g USING (video)),
re AS (SELECT *, CASE WHEN t IS NULL THEN 0e0 ELSE least(1e0, coverage * 1.2e0) * (0.45e0 + 0.55e0 * 5 / 8e0) * CASE WHEN n_evidence = 1 THEN 0.7e0 ELSE 1e0 END END AS confidence,
  CASE WHEN t IS NULL THEN 'not enough to say' ELSE {QUADRANT} END AS label FROM rd)"""


def affect(spark, sf_dir):
    rows = totals(spark, sf_dir).withColumn("duration", F.col("duration") / 20.0)
    return rules.read_affect(spans(spark, sf_dir).drop("value"), affect_dim(spark), rows, ["video"], known=len(BEHAVIOUR_OF), min_score=0.5)


@register("affect_reading", f"WITH {READ} SELECT video, round(valence, 9) AS valence, round(arousal, 9) AS arousal, round(coverage, 9) AS coverage, round(confidence, 9) AS confidence, label, n_evidence FROM re")
def affect_reading(spark, sf_dir):
    out = affect(spark, sf_dir)
    return out.select("video", *[F.round(c, 9).alias(c) for c in ("valence", "arousal", "coverage", "confidence")], "label", "n_evidence")


@register("affect_quadrant", f"WITH {READ} SELECT label, count(*) AS n FROM re GROUP BY label")
def affect_quadrant(spark, sf_dir):
    return affect(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


@register("needs_review", f"WITH {READ} SELECT video, valence < -0.15e0 OR n_stress >= 2 OR (arousal > 0.7e0 AND valence < 0) AS review FROM re")
def needs_review(spark, sf_dir):
    return affect(spark, sf_dir).select("video", rules.needs_review(F.col("valence"), F.col("arousal"), F.size("stress")).alias("review"))


FEATURES = [("seconds", 0.1, 3.0), ("f0", 0.0, 900.0), ("periodicity", 0.0, 1.0), ("flatness", 0.0, 0.6), ("centroid", 200.0, 4000.0), ("loudness", -60.0, 40.0), ("modulation", 0.0, 0.5), ("formant", 0.3, 0.6), ("high", 0.0, 0.5), ("rate", 0.0, 6.0)]


def voice_features(spark, sf_dir):
    """Acoustic features of a clip per vector: its first dimensions, mapped into each feature's range."""
    x = lambda i: F.round(F.least(F.lit(1.0), F.abs(F.element_at("embedding", i)).cast("double") * 4.0), 3)
    rows = [(F.lit(low) + F.lit(width) * x(i + 1)).alias(name) for i, (name, low, width) in enumerate(FEATURES)]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("video"), *rows)


def _voice() -> str:
    cols = ", ".join(f"{low}e0 + {width}e0 * round(least(1e0, abs(CAST(embedding[{i + 1}] AS DOUBLE)) * 4e0), 3) AS {name}" for i, (name, low, width) in enumerate(FEATURES))
    dim = ", ".join(f"('{k}', {v}e0, {a}e0, {str(c).lower()})" for k, v, a, c in VOICE)
    return f"""vf AS (SELECT vec_id AS id, label AS video, {cols} FROM embeddings), vd(kind, va, ar, concerning) AS (VALUES {dim}),
sp AS (SELECT *, CASE WHEN seconds < 0.25e0 OR f0 <= 0 THEN 0e0 ELSE greatest(0e0, least(1e0, CASE WHEN f0 BETWEEN 85 AND 300 THEN 0.35e0 ELSE 0e0 END + CASE WHEN formant > 0.6e0 THEN 0.2e0 ELSE 0e0 END
  + CASE WHEN modulation > 0.05e0 AND modulation < 0.45e0 THEN 0.2e0 ELSE 0e0 END + CASE WHEN seconds > 0.6e0 THEN 0.15e0 ELSE 0e0 END + CASE WHEN periodicity > 0.45e0 THEN 0.1e0 ELSE 0e0 END - CASE WHEN high > 0.25e0 THEN 0.2e0 ELSE 0e0 END)) END AS speech,
  periodicity > 0.35e0 AND flatness < 0.3e0 AS tonal, seconds BETWEEN 0.05e0 AND 0.6e0 AND loudness > -40 AND centroid > 400 AS bark FROM vf),
k0 AS (SELECT *, CASE WHEN speech > 0.6e0 THEN 'speech' WHEN seconds < 0.18e0 AND f0 > 600 AND periodicity > 0.4e0 THEN 'yelp' WHEN seconds >= 0.3e0 AND f0 > 0 AND f0 < 350 AND (flatness > 0.1e0 OR periodicity < 0.65e0) THEN 'growl'
  WHEN seconds BETWEEN 0.7e0 AND 3.5e0 AND f0 BETWEEN 200 AND 1400 AND periodicity > 0.5e0 AND modulation > 0.12e0 THEN 'howl' WHEN seconds >= 0.22e0 AND f0 > 450 AND periodicity > 0.35e0 THEN 'whine'
  WHEN bark AND f0 > 0 AND f0 < 450 AND flatness > 0.14e0 THEN 'bark_alarm' WHEN bark AND f0 >= 450 AND tonal THEN 'bark_excited' WHEN bark THEN 'bark'
  WHEN seconds > 0.6e0 AND flatness > 0.35e0 AND centroid < 2500 AND NOT tonal THEN 'pant' ELSE 'sound' END AS k FROM sp),
k1 AS (SELECT *, CASE k WHEN 'speech' THEN least(0.6e0, speech) WHEN 'yelp' THEN 0.55e0 WHEN 'growl' THEN 0.55e0 WHEN 'howl' THEN 0.5e0 WHEN 'whine' THEN 0.55e0 WHEN 'bark_alarm' THEN 0.5e0 WHEN 'bark_excited' THEN 0.5e0 WHEN 'bark' THEN 0.45e0
  WHEN 'pant' THEN 0.4e0 ELSE 0.35e0 END AS c, k IN ('bark', 'bark_excited') AND rate >= 3 AND f0 < 700 AS alarm FROM k0),
vk AS (SELECT id, video, seconds, CASE WHEN alarm THEN 'bark_alarm' ELSE k END AS kind, CASE WHEN alarm THEN least(0.55e0, c + 0.05e0) ELSE c END * CASE WHEN loudness < -45 AND k <> 'speech' THEN 0.7e0 ELSE 1e0 END AS confidence, rate FROM k1),
vt AS (SELECT vk.*, va AS valence, CASE WHEN rate >= 3 AND kind LIKE 'bark%' THEN least(1e0, ar + 0.1e0) ELSE ar END AS arousal, concerning FROM vk JOIN vd USING (kind))"""


VOICED = _voice()


@register("voice_typing", f"WITH {VOICED} SELECT id, kind, round(confidence, 9) AS confidence, round(arousal, 9) AS arousal, concerning FROM vt")
def voice_typing(spark, sf_dir):
    out = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark))
    return out.select("id", "kind", F.round("confidence", 9).alias("confidence"), F.round("arousal", 9).alias("arousal"), "concerning")


HEARD = f"""{VOICED}, hg AS (SELECT video, sum(confidence * greatest(0.05e0, least(1e0, seconds))) AS t, sum(valence * confidence * greatest(0.05e0, least(1e0, seconds))) AS v, sum(arousal * confidence * greatest(0.05e0, least(1e0, seconds))) AS a,
  count(*) AS n, sum(seconds) AS s FROM vt WHERE kind NOT IN ('sound', 'speech') GROUP BY video),
hr AS (SELECT video, coalesce(v / t, 0e0) AS valence, coalesce(a / t, 0e0) AS arousal, coalesce(least(1e0, t / 2e0) * least(1e0, 0.4e0 + 0.15e0 * n), 0e0) AS confidence, least(1e0, coalesce(s, 0e0) / 60e0) AS vocal_fraction, coalesce(n, 0) AS n_events
  FROM (SELECT DISTINCT video FROM vt) LEFT JOIN hg USING (video))"""


def audio(spark, sf_dir):
    events = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark))
    return rules.read_audio(events, events.select("video").distinct().withColumn("duration", F.lit(60.0)), ["video"])


@register("audio_reading", f"WITH {HEARD} SELECT video, round(valence, 9) AS valence, round(arousal, 9) AS arousal, round(confidence, 9) AS confidence, round(vocal_fraction, 9) AS vocal_fraction, n_events FROM hr")
def audio_reading(spark, sf_dir):
    out = audio(spark, sf_dir)
    return out.select("video", *[F.round(c, 9).alias(c) for c in ("valence", "arousal", "confidence", "vocal_fraction")], "n_events")


BLENDED = f"""{READ}, {HEARD}, ur AS (SELECT video, max(arousal) AS ua FROM vt WHERE concerning AND kind NOT IN ('sound', 'speech') GROUP BY video),
b0 AS (SELECT re.video, re.valence AS v1, re.arousal AS a1, re.confidence AS c1, coalesce(hr.valence, 0e0) AS v2, coalesce(hr.arousal, 0e0) AS a2, coalesce(hr.confidence, 0e0) AS c2, ua FROM re LEFT JOIN hr USING (video) LEFT JOIN ur USING (video)),
b1 AS (SELECT *, CASE WHEN c1 > 0 THEN greatest(0.2e0, c1) ELSE 0e0 END AS w1, CASE WHEN c2 > 0 THEN greatest(0.2e0, c2) * 1.3e0 ELSE 0e0 END AS w2 FROM b0),
b2 AS (SELECT *, CASE WHEN w1 + w2 > 0 THEN (v1 * w1 + v2 * w2) / (w1 + w2) ELSE 0e0 END AS v, CASE WHEN w1 + w2 > 0 THEN (a1 * w1 + a2 * w2) / (w1 + w2) ELSE 0e0 END AS a FROM b1),
b3 AS (SELECT *, ua IS NOT NULL AND ((c1 > 0 AND v1 > 0.2e0) OR v > 0.15e0) AS disagree FROM b2)"""


def blended(spark, sf_dir):
    seen = affect(spark, sf_dir).select("video", *[F.col(c).alias(f"affect_{c}") for c in ("valence", "arousal", "confidence")])
    heard = audio(spark, sf_dir).select("video", *[F.col(c).alias(f"audio_{c}") for c in ("valence", "arousal", "confidence")])
    events = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark)).where("concerning AND kind NOT IN ('sound', 'speech')")
    rows = seen.join(heard, "video", "left").na.fill(0.0, ["audio_valence", "audio_arousal", "audio_confidence"])
    return rules.blend(rows.join(events.groupBy("video").agg(F.max("arousal").alias("urgent_arousal")), "video", "left"))


@register(
    "translation_state",
    f"""WITH {BLENDED} SELECT video, round(CASE WHEN disagree THEN least(v, 0.15e0) ELSE v END, 9) AS valence, round(CASE WHEN ua IS NOT NULL THEN greatest(a, ua) ELSE a END, 9) AS arousal,
    round(least(1e0, (w1 + w2) / 2.2e0), 9) AS confidence, disagree FROM b3""",
)
def translation_state(spark, sf_dir):
    return blended(spark, sf_dir).select("video", *[F.round(c, 9).alias(c) for c in ("valence", "arousal", "confidence")], "disagree")


@register(
    "state_lookup",
    f"""WITH {READ}, s AS (SELECT video, arousal, valence, CASE WHEN video % 3 = 0 THEN 'growl' ELSE '' END AS voice FROM re),
    k AS (SELECT video, unnest([{{'p': 0, 'k': voice}}, {{'p': 1, 'k': 'sitting'}}, {{'p': 2, 'k': CASE WHEN valence >= 0.2e0 THEN 'positive_' WHEN valence <= -0.15e0 THEN 'negative_' ELSE 'neutral' END
      || CASE WHEN valence >= 0.2e0 OR valence <= -0.15e0 THEN CASE WHEN arousal >= 0.55e0 THEN 'high' ELSE 'low' END ELSE '' END}}, {{'p': 3, 'k': 'default'}}], recursive := true) FROM s)
    SELECT video AS id, k AS key FROM k WHERE k IN ('growl', 'positive_high', 'neutral', 'default') QUALIFY row_number() OVER (PARTITION BY video ORDER BY p) = 1""",
)
def state_lookup(spark, sf_dir):
    rows = affect(spark, sf_dir).withColumn("keys", rules.state_keys(F.lit("sitting"), F.when(F.col("video") % 3 == 0, "growl").otherwise(""), F.col("arousal"), F.col("valence")))
    lines = spark.createDataFrame([(k, k.upper()) for k in ("growl", "positive_high", "neutral", "default")], "key string, value string")
    return rules.resolve(rows, lines, "video", "keys").select("id", "key")


# Rules for the advice query: what was seen or heard, the suggestion and its priority.
BEHAVIOUR_RULES = [("playing", 0, "let the play go on", 3), ("barking", 0, "find what sets it off", 2), ("running", 0, "offer water", 3), ("sniffing", 0, "give it time to sniff", 3), ("sitting", 0, "nothing to do", 3)]
VOICE_RULES = [("growl", 0, "give it room", 1), ("yelp", 0, "look for an injury", 1), ("whine", 0, "find what it asks for", 2), ("bark_alarm", 0, "find what sets it off", 2), ("howl", 0, "do not leave it alone for long", 3)]


def _rules(name: str, rows: list, key: str) -> str:
    return f"{name}({key}, place, text, priority) AS (VALUES " + ", ".join(f"('{k}', {i}, '{t}', {p})" for k, i, t, p in rows) + ")"


@register(
    "advice_topk",
    f"""WITH {BLENDED}, {_rules('br', BEHAVIOUR_RULES, 'behaviour')}, {_rules('vr', VOICE_RULES, 'kind')}, se AS (SELECT video, behaviour, sum("end" - start) AS s FROM ev GROUP BY ALL),
    f AS (SELECT vt.video, text, priority, 0 AS a, CAST(id AS DOUBLE) AS b, kind AS c, place FROM vt JOIN vr USING (kind)
      UNION ALL SELECT video, text, priority, 1, -s, behaviour, place FROM se JOIN br USING (behaviour) WHERE s >= 0.5e0
      UNION ALL SELECT video, 'worked up and unhappy: lower the pressure', 1, 2, 0e0, '', 1 FROM re WHERE confidence > 0.2e0 AND valence < -0.2e0 AND arousal > 0.6e0
      UNION ALL SELECT video, 'quiet and withdrawn: watch for a change', 2, 2, 0e0, '', 2 FROM re WHERE confidence > 0.2e0 AND valence < -0.2e0 AND arousal < 0.35e0
      UNION ALL SELECT video, 'several stress signals: look for what they share', 2, 2, 0e0, '', 3 FROM re WHERE confidence > 0.2e0 AND n_stress >= 2),
    d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video, text ORDER BY a, b, c, place) = 1)
    SELECT video, CAST(row_number() OVER (PARTITION BY video ORDER BY priority, a, b, c, place, text) AS INT) AS rank, text, CAST(priority AS INT) AS priority FROM d
    QUALIFY row_number() OVER (PARTITION BY video ORDER BY priority, a, b, c, place, text) <= 6""",
)
def advice_topk(spark, sf_dir):
    rule = "place int, text string, priority int"
    heard = rules.voice_kind(voice_features(spark, sf_dir), voice_dim(spark)).select(F.col("video").cast("long").alias("video"), F.col("id").alias("start"), "kind")
    seen = rules.time_per_behaviour(spans(spark, sf_dir), ["video"])
    state = affect(spark, sf_dir).withColumn("n_stress", F.size("stress"))
    return rules.advise(heard, seen, state, ["video"], spark.createDataFrame(VOICE_RULES, "kind string, " + rule), spark.createDataFrame(BEHAVIOUR_RULES, "behaviour string, " + rule))


def enriched(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("barking"))).otherwise(F.array(F.col("lang"))).alias("labels"))
    heard = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video"), F.create_map(F.lit("bark"), F.col("quality").cast("int"), F.lit("bark_alarm"), F.col("toxic").cast("int"), F.lit("whine"), F.lit(3)).alias("kinds"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))
    return rules.enrich(rows, heard, "video", "barking", ["bark", "bark_alarm", "bark_excited"], 1, 0.3)


ENRICH = """en AS (SELECT d.doc_id AS video, CASE WHEN d.doc_id % 11 = 0 THEN 'barking' ELSE lang END AS l, coalesce(quality, 0) + coalesce(toxic, 0) AS events,
  CASE WHEN d.doc_id % 11 = 0 THEN 'already_labelled' WHEN l.doc_id IS NULL THEN 'skipped_missing_audio' WHEN quality + toxic >= 1 AND d.doc_id % 10 / 10e0 >= 0.3e0 THEN 'added' ELSE 'no_audio_signal' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@register("enrich_labels", f"WITH {ENRICH} SELECT video, CASE WHEN status = 'added' THEN l || ',barking' ELSE l END AS labels, CAST(events AS INT) AS events, status FROM en")
def enrich_labels(spark, sf_dir):
    return enriched(spark, sf_dir).select("video", F.array_join("labels", ",").alias("labels"), "events", "status")


@register("enrich_stats", f"WITH {ENRICH} SELECT status, count(*) AS n FROM en GROUP BY status")
def enrich_stats(spark, sf_dir):
    return enriched(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@register(
    "condition_vector",
    f"""WITH {SPANS}, {TOTALS}, c AS (SELECT video, count(*) FILTER (type = 'view') AS v, count(*) FILTER (type = 'error') AS e, avg(score) AS s FROM ev GROUP BY video)
    SELECT video, CAST(unnest(range(0, 14)) AS INT) AS i, round(unnest([s, 1e0 - s, 0e0, ln(1e0 + v) / 3e0, 0e0, 0e0, ln(1e0 + e) / 3e0, 0e0, 0e0, 0e0, 0.5e0, 0e0, 0e0, ln(1e0 + duration) / 4e0]), 9) AS x FROM c JOIN tot USING (video)""",
)
def condition_vector(spark, sf_dir):
    rows = spans(spark, sf_dir).groupBy("video").agg(F.count_if(F.col("type") == "view").cast("int").alias("v"), F.count_if(F.col("type") == "error").cast("int").alias("e"), F.avg("score").alias("s"))
    rows = rows.join(totals(spark, sf_dir), "video")
    kinds = F.create_map(F.lit("growl"), F.col("v"), F.lit("bark_alarm"), F.col("e"))
    vector = rules.condition_vector(F.array(F.col("s"), 1.0 - F.col("s")), kinds, F.lit(0.5), F.lit(0.0), F.lit(None).cast("double"), F.col("duration"))
    return rows.select("video", F.posexplode(vector).alias("i", "x")).withColumn("x", F.round("x", 9))
