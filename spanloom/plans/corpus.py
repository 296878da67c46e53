"""Queries on imports, label maps and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import audit, text
from spanloom.plans.bindings import SPANS, micros, spans, table
from spanloom.plans.registry import register
from spanloom.schema import ACTIONS, AROUSAL_FLAGS, POSTURES, VOICE_KINDS, label_dim
from spanloom.sources import annotations as src

MAPPING = {"standard": "common", "small": "common", "economy": "cheap", "PROMO": "offer"}


def part_labels(spark, sf_dir, keep):
    raw = F.array("p_type", F.concat(F.lit(" "), F.col("p_brand"), F.lit(" ")), F.lit(""))
    labels, lost = src.map_labels(raw, MAPPING, keep)
    return table(spark, sf_dir, "part").select("p_partkey", labels.alias("labels"), lost.alias("unmapped"))


MAP = "CASE lower(p_type) WHEN 'standard' THEN 'common' WHEN 'small' THEN 'common' WHEN 'economy' THEN 'cheap' WHEN 'promo' THEN 'offer' END"


@register("label_map_apply", f"SELECT p_partkey, coalesce({MAP}, replace(replace(lower(p_type), ' ', '_'), '-', '_')) || ',' || replace(replace(lower(trim(p_brand)), ' ', '_'), '-', '_') AS labels FROM part")
def label_map_apply(spark, sf_dir):
    return part_labels(spark, sf_dir, True).select("p_partkey", F.array_join("labels", ",").alias("labels"))


@register("unmapped_labels", f"SELECT name, count(*) AS n FROM (SELECT p_type AS name FROM part WHERE {MAP} IS NULL UNION ALL SELECT trim(p_brand) FROM part) GROUP BY name")
def unmapped_labels(spark, sf_dir):
    return src.unmapped_counts(part_labels(spark, sf_dir, False))


@register(
    "multi_hot_encode",
    "SELECT event_id AS id, CAST(unnest(range(0, 3)) AS INT) AS i, CAST(unnest([event_type = 'click', event_type = 'view', event_type = 'error']) AS INT) AS x FROM events WHERE event_type IN ('click', 'view', 'error')",
)
def multi_hot_encode(spark, sf_dir):
    names = ["click", "view", "error"]
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.array("event_type").alias("labels"))
    valid = rows.where(F.size(F.array_except("labels", F.array(*map(F.lit, names)))) == 0)
    hot = F.array(*[F.array_contains("labels", n).cast("int") for n in names])
    return valid.select("id", F.posexplode(hot).alias("i", "x"))


@register(
    "import_report",
    "SELECT count(*) AS n_spans, count(DISTINCT url) AS n_videos, count(DISTINCT regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '^(.+)\\.[^.]*$', '\\1')) AS n_groups FROM pages",
)
def import_report(spark, sf_dir):
    return src.import_report(table(spark, sf_dir, "pages").select(F.col("url").alias("video"), F.lit("").alias("group")))


@register("json_props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@register("html_tag_runs", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL")
def html_tag_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@register("merged_keyframes", """SELECT user_id AS video, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS labels FROM events GROUP BY ALL""")
def merged_keyframes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.floor(micros("ts") / 3600000000).alias("hour"), "event_type")
    return rows.groupBy("video", "hour").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("labels"))


SUGGEST = ["standart", "medum", "promotion", "larges", "tiny", "economic"]


@register(
    "lcs_suggest",
    f"""WITH RECURSIVE n AS (SELECT DISTINCT lower(p_type) AS a FROM part), l AS (SELECT CAST(i - 1 AS INT) AS idx, x AS b FROM (SELECT unnest(range(1, 7)) AS i, unnest({SUGGEST}) AS x)),
    s AS (SELECT a, b, idx, 1 AS i, list_transform(range(0, length(b) + 1), lambda j: 0) AS r FROM n, l
      UNION ALL SELECT a, b, idx, i + 1, list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(b, j, 1) = substr(a, i, 1) THEN r[j] + 1 ELSE greatest(r[j + 1], acc[j]) END), [0])
      FROM s WHERE i <= length(a)),
    f AS (SELECT a, b, idx, 2e0 * r[length(b) + 1] / (length(a) + length(b)) AS sim FROM s WHERE i = length(a) + 1)
    SELECT a AS name, CASE WHEN sim > 0.6e0 THEN b END AS suggestion, sim AS score FROM f QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, idx) = 1""",
)
def lcs_suggest(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_type").alias("name"))
    dim = spark.createDataFrame(list(enumerate(SUGGEST)), "idx int, name string")
    return audit.closest(names, dim)


TAXONOMY = ", ".join(f"({i}, '{n}', {str(n in POSTURES).lower()}, {str(n in AROUSAL_FLAGS).lower()})" for i, n in enumerate(POSTURES + ACTIONS))


@register("taxonomy", f"SELECT CAST(i AS INT) AS idx, n AS name, p AS is_posture, a AS is_arousal_flag FROM (VALUES {TAXONOMY}) t(i, n, p, a)")
def taxonomy(spark, sf_dir):
    return label_dim(spark)


@register("tokenize", """SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9'']+|[.,!?;]')) AS BIGINT) AS n FROM documents""")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


VOCAB = """tk AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+|[.,!?;]')) AS token FROM conversations),
vo AS (SELECT token, count(*) AS n FROM tk GROUP BY token HAVING count(*) >= 2)"""


def vocab(spark, sf_dir):
    return text.vocabulary(table(spark, sf_dir, "conversations"), "text", 2)


@register("vocabulary", f"WITH {VOCAB} SELECT token, n, row_number() OVER (ORDER BY token) + 3 AS id FROM vo UNION ALL SELECT * FROM (VALUES ('<pad>', 0, 0), ('<bos>', 0, 1), ('<eos>', 0, 2), ('<unk>', 0, 3))")
def vocabulary(spark, sf_dir):
    return vocab(spark, sf_dir)


@register("encode_text", f"""WITH {VOCAB}, vi AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM vo), e AS (SELECT doc_id, sum(coalesce(id, 3)) AS s, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+|[.,!?;]')) AS token FROM documents) LEFT JOIN vi USING (token) GROUP BY doc_id)
    SELECT doc_id, CAST(s + 3 AS BIGINT) AS id_sum, n + 2 AS n FROM e""")
def encode_text(spark, sf_dir):
    ids = text.encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocab(spark, sf_dir))
    return ids.select("doc_id", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.size("ids").cast("long").alias("n"))


@register(
    "corpus_stats",
    """WITH w AS (SELECT text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations)
    SELECT count(*) AS n, count(DISTINCT text) AS "distinct", count(DISTINCT text) / CAST(count(*) AS DOUBLE) AS distinct_ratio, (SELECT count(DISTINCT x) FROM (SELECT unnest(w) AS x FROM w)) AS vocabulary,
    round(sum(len(w)) / CAST(count(*) AS DOUBLE), 9) AS mean_words, CAST(min(len(w)) AS BIGINT) AS min_words, CAST(max(len(w)) AS BIGINT) AS max_words FROM w""",
)
def corpus_stats(spark, sf_dir):
    return text.corpus_stats(table(spark, sf_dir, "conversations"), "text").withColumn("mean_words", F.round("mean_words", 9))


@register(
    "dialogue_stats",
    """WITH q AS (SELECT a.text AS q, b.text AS a, a.conv_id % 5 AS intent FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
    t AS (SELECT *, regexp_extract_all(lower(q), '[a-z0-9'']+|[.,!?;]') AS tq, regexp_extract_all(lower(a), '[a-z0-9'']+|[.,!?;]') AS ta FROM q)
    SELECT count(*) AS pairs, count(DISTINCT a) AS distinct_answers, count(DISTINCT q) AS distinct_questions, count(DISTINCT intent) AS intents, round(avg(len(ta)), 9) AS mean_answer_words,
    (SELECT count(DISTINCT x) FROM (SELECT unnest(list_concat(tq, ta)) AS x FROM t)) AS vocabulary FROM t""",
)
def dialogue_stats(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    pairs = turns.where("role = 'user'").join(answers, ["conv_id", "turn"]).select(F.col("text").alias("q"), "a", (F.col("conv_id") % 5).alias("intent"))
    return text.dialogue_stats(pairs, "q", "a", "intent").withColumn("mean_answer_words", F.round("mean_answer_words", 9))


@register(
    "out_of_domain",
    f"""WITH {VOCAB}, b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+|[.,!?;]')) AS token FROM benchmark), r AS (SELECT item_id, count(*) AS t, count(*) FILTER (token NOT IN (SELECT token FROM vo)) AS u FROM b GROUP BY item_id)
    SELECT item_id, t AS n_tokens, u AS n_unknown, round(u / CAST(t AS DOUBLE), 9) AS ratio, u / CAST(t AS DOUBLE) > 0.4e0 AS uncertain FROM r""",
)
def out_of_domain(spark, sf_dir):
    return text.out_of_domain(table(spark, sf_dir, "benchmark"), "item_id", "text", vocab(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


VOICES = ", ".join(f"('{v}')" for v in ["", *VOICE_KINDS])


@register(
    "dialogue_grid",
    f"""WITH g AS (SELECT * FROM (VALUES ('playing'), ('sitting'), ('barking'), ('running'), ('sniffing')) b(behaviour), (VALUES {VOICES}) v(voice), (VALUES (0.15e0), (0.4e0), (0.7e0), (0.9e0)) a(arousal),
      (VALUES (-0.7e0), (-0.3e0), (0e0), (0.4e0), (0.8e0)) x(valence), range(0, 12) i(intent), range(0, 2) r(rep))
    SELECT behaviour, voice, arousal, valence, 'intent' || CAST(intent AS VARCHAR) AS intent, CAST(rep AS INT) AS repeat, (CASE WHEN voice <> '' THEN voice || ',' ELSE '' END) || behaviour || ','
    || (CASE WHEN valence >= 0.2e0 THEN 'positive_' || CASE WHEN arousal >= 0.55e0 THEN 'high' ELSE 'low' END WHEN valence <= -0.15e0 THEN 'negative_' || CASE WHEN arousal >= 0.55e0 THEN 'high' ELSE 'low' END ELSE 'neutral' END) || ',default' AS keys FROM g""",
)
def dialogue_grid(spark, sf_dir):
    grid = text.dialogue_grid(spark, ["playing", "sitting", "barking", "running", "sniffing"], [f"intent{i}" for i in range(12)])
    return grid.withColumn("keys", F.array_join("keys", ","))


def chosen(options: list[str], *seed: str) -> str:
    """text.choose in SQL."""
    at = f"CAST('0x' || substr(sha256(concat_ws('|', {', '.join(seed)})), 1, 15) AS BIGINT) % {len(options)} + 1"
    return f"list_extract([{', '.join(repr(o) for o in options)}], CAST({at} AS INT))"


@register(
    "captions",
    f"""WITH {SPANS}, c AS (SELECT id, video, behaviour, {chosen(['The dog', 'It'], 'CAST(id AS VARCHAR)', "'subject'")} || ' is ' || replace(behaviour, '_', ' ') || ' ' ||
      CASE WHEN "end" - start < 2 THEN 'briefly' WHEN "end" - start < 6 THEN 'for a moment' WHEN "end" - start < 15 THEN 'for a while' ELSE 'for a long time' END AS act FROM ev)
    SELECT id, video, act || CASE WHEN behaviour = 'barking' THEN {chosen([' and it gives a ', ', and it gives a '], 'CAST(id AS VARCHAR)', "'link'")} || 'bark alarm twice.'
      ELSE {chosen(['', ' and stays quiet'], 'CAST(id AS VARCHAR)', "'silence'")} || '.' END AS caption FROM c""",
)
def captions(spark, sf_dir):
    rows = spans(spark, sf_dir)
    voice = F.when(F.col("behaviour") == "barking", "bark_alarm")
    sentence = text.compose_caption(F.col("id").cast("string"), F.array("behaviour"), F.col("end") - F.col("start"), voice, F.lit(2))
    return rows.select("id", "video", sentence.alias("caption"))


@register(
    "caption_lengths",
    f"""WITH {SPANS} SELECT CASE WHEN "end" - start < 2 THEN 'briefly' WHEN "end" - start < 6 THEN 'for a moment' WHEN "end" - start < 15 THEN 'for a while' ELSE 'for a long time' END AS words, count(*) AS n FROM ev GROUP BY ALL""",
)
def caption_lengths(spark, sf_dir):
    return spans(spark, sf_dir).groupBy(text.duration_words(F.col("end") - F.col("start")).alias("words")).agg(F.count("*").alias("n"))


@register(
    "padded_pairs",
    """WITH t AS (SELECT doc_id, list_slice(list_transform(regexp_extract_all(lower(text), '[a-z0-9'']+|[.,!?;]'), lambda x: length(x)), 1, 17) AS c FROM documents)
    SELECT doc_id, CAST(coalesce(list_sum(list_slice(c, 1, greatest(0, len(c) - 1))), 0) AS BIGINT) AS input_sum, CAST(coalesce(list_sum(list_slice(c, 2, len(c))), 0) AS BIGINT) AS target_sum, 16 AS n FROM t""",
)
def padded_pairs(spark, sf_dir):
    ids = F.transform(text.tokens(F.col("text")), lambda t: F.length(t).cast("long"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.padded(ids, 16).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", total(F.col("p.input")).alias("input_sum"), total(F.col("p.target")).alias("target_sum"), F.size("p.input").alias("n"))
