"""How the driver's tables stand for annotations, spans, windows and scores, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BEHAVIOUR_OF = {"view": "sniffing", "signup": "playing", "click": "sitting", "error": "barking", "purchase": "running"}
EPOCH = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds of a zone-less time since 1970, whatever the session's zone (the tables lie within one winter)."""
    return F.expr(f"{EPOCH} + timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', {ts})")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as spans: video, id, start, end (seconds), type, behaviour, score, value."""
    names = F.create_map(*[F.lit(x) for kv in BEHAVIOUR_OF.items() for x in kv])
    start = (micros("ts") - EPOCH).cast("double") / 1e6
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video"),
        F.col("event_id").alias("id"),
        start.alias("start"),
        (start + F.col("value") * 60.0).alias("end"),
        F.col("event_type").alias("type"),
        names[F.col("event_type")].alias("behaviour"),
        (1.0 / (1.0 + F.exp((50.0 - F.col("value")) / 40.0))).alias("score"),
        "value",
    )


CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BEHAVIOUR_OF.items()) + " END"
SPANS = f"""ev AS (SELECT user_id AS video, event_id AS id, CAST(epoch_us(ts) - {EPOCH} AS DOUBLE) / 1e6 AS start,
  CAST(epoch_us(ts) - {EPOCH} AS DOUBLE) / 1e6 + value * 60e0 AS "end", event_type AS type, {CASE} AS behaviour,
  1e0 / (1e0 + exp((50e0 - value) / 40e0)) AS score, value FROM events)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order as score windows of 1 s every 0.5 s: video, w, t0, t1, score, mask."""
    line = Window.partitionBy("video").orderBy("start", "id")
    rows = spans(spark, sf_dir).withColumn("w", F.row_number().over(line))
    return rows.select("video", F.col("w").cast("long").alias("w"), ((F.col("w") - 1) * 0.5).alias("t0"), ((F.col("w") - 1) * 0.5 + 1.0).alias("t1"), "score", (F.col("score") >= 0.5).alias("mask"), "value")


WINDOWS = f"""{SPANS}, wi AS (SELECT video, w, (w - 1) * 0.5e0 AS t0, (w - 1) * 0.5e0 + 1e0 AS t1, score, score >= 0.5e0 AS mask, value
  FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start, id) AS w FROM ev))"""


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video, duration: from the first span's start to the last one's end."""
    return spans(spark, sf_dir).groupBy("video").agg((F.max("end") - F.min("start")).alias("duration"))


TOTALS = """tot AS (SELECT video, max("end") - min(start) AS duration FROM ev GROUP BY video)"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in long form: id, class (quality, toxic), logit from the length, target."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    length = F.log(F.col("n_chars").cast("double") + 1.0)
    logit = F.round((length - 7.0) * 1.5, 2)
    rows = F.array(
        F.struct(F.lit("quality").alias("class"), logit.alias("logit"), F.col("quality").cast("int").alias("target")),
        F.struct(F.lit("toxic").alias("class"), (-logit).alias("logit"), F.col("toxic").cast("int").alias("target")),
    )
    return docs.select(F.col("doc_id").alias("id"), F.explode(rows).alias("r")).select("id", "r.*")


SCORED = """ld AS (SELECT d.doc_id AS id, quality, toxic, round((ln(CAST(n_chars AS DOUBLE) + 1e0) - 7e0) * 1.5e0, 2) AS lg FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
sd AS (SELECT id, 'quality' AS class, lg AS logit, CAST(quality AS INT) AS target FROM ld UNION ALL SELECT id, 'toxic', -lg, CAST(toxic AS INT) FROM ld),
sc AS (SELECT *, 1e0 / (1e0 + exp(-logit)) AS score FROM sd)"""


def class_logits(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """embeddings as n-class logits in long form: id, class, logit, truth."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), F.posexplode(F.slice("embedding", 1, n)).alias("class", "logit"))
    return rows.select("id", "truth", "class", F.col("logit").cast("double").alias("logit"))


LOGITS = """lo AS (SELECT vec_id AS id, label AS truth, i - 1 AS class, CAST(embedding[i] AS DOUBLE) AS logit FROM (SELECT *, unnest(range(1, 11)) AS i FROM embeddings))"""
