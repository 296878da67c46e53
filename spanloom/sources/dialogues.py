"""Readers and writers of caption corpora and of dialogues, as JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOICE = "struct<kinds: map<string,long>, arousal: double, valence: double, vocal_fraction: double>"
CORPUS = f"video string, caption string, labels array<string>, duration double, `group` string, audio {VOICE}"
DIALOGUE = "question string, answer string, intent string, state struct<behaviour: string, voice: string, arousal: double, valence: double>"


def needed(df: DataFrame, *names: str) -> DataFrame:
    """The frame, raising when read where one of these columns is null."""
    return df.withColumns({n: F.coalesce(n, F.raise_error(F.lit(f"a record has no {n}"))) for n in names})


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """video, caption, labels, duration, group, audio; what a record leaves out is empty or 0."""
    rows = needed(spark.read.schema(CORPUS).json(path), "video", "caption")
    voice = F.struct(
        F.coalesce("audio.kinds", F.create_map().cast("map<string,long>")).alias("kinds"),
        *[F.coalesce(f"audio.{c}", F.lit(0.0)).alias(c) for c in ("arousal", "valence", "vocal_fraction")],
    )
    filled = {"labels": F.coalesce("labels", F.array().cast("array<string>")), "duration": F.coalesce("duration", F.lit(0.0)), "group": F.coalesce("group", F.lit("")), "audio": voice}
    return rows.withColumns(filled)


def write_corpus(df: DataFrame, path: str) -> None:
    """The columns of read_corpus, durations with three decimals."""
    df.select("video", "caption", "labels", F.bround("duration", 3).alias("duration"), "group", "audio").write.mode("overwrite").json(path)


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """question, answer, intent, behaviour, voice, arousal, valence."""
    rows = needed(spark.read.schema(DIALOGUE).json(path), "question", "answer", "state")
    return rows.select("question", "answer", F.coalesce("intent", F.lit("")).alias("intent"), "state.*")


def write_dialogues(df: DataFrame, path: str) -> None:
    df.select("question", "answer", "intent", F.struct("behaviour", "voice", "arousal", "valence").alias("state")).write.mode("overwrite").json(path)
