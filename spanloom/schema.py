"""Row schemas and the fixed dimensions: label space, affect, voice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ANNOTATION = (
    "video string, labels array<string>, start double, end double, `group` string, subject string, weight double, meta map<string,string>"
)
SPAN = "video string, behaviour string, start double, end double, score double, peak double"
WINDOW = "video string, w long, t0 double, t1 double, class string, score double"

# The label space, in order.
POSTURES = ["lying_down", "sitting", "standing", "walking", "trotting", "running"]
ACTIONS = [
    "jumping", "playing", "chewing", "eating_drinking", "sniffing", "digging", "barking", "tail_wagging", "scratching", "shaking_off", "rolling", "stretching",
    "yawning", "eliminating", "alert_freeze",
]
AROUSAL_FLAGS = ["barking", "alert_freeze", "scratching", "shaking_off", "yawning"]

# Behaviour, valence, arousal, weight, stress signal.
AFFECT = [
    ("lying_down", 0.15, 0.05, 0.8, False), ("sitting", 0.05, 0.25, 0.4, False), ("standing", 0.0, 0.35, 0.2, False), ("walking", 0.1, 0.45, 0.4, False),
    ("trotting", 0.1, 0.65, 0.4, False), ("running", 0.15, 0.9, 0.5, False), ("playing", 0.85, 0.8, 1.4, False), ("tail_wagging", 0.5, 0.6, 0.7, False),
    ("chewing", 0.5, 0.4, 0.8, False), ("eating_drinking", 0.45, 0.35, 0.9, False), ("stretching", 0.35, 0.2, 0.6, False), ("rolling", 0.4, 0.5, 0.5, False),
    ("sniffing", 0.3, 0.4, 0.7, False), ("digging", 0.2, 0.7, 0.4, False), ("jumping", 0.4, 0.85, 0.6, False), ("eliminating", 0.0, 0.3, 0.2, False),
    ("yawning", -0.35, 0.4, 0.6, True), ("scratching", -0.3, 0.45, 0.5, True), ("shaking_off", -0.2, 0.5, 0.4, True), ("barking", -0.3, 0.85, 0.8, True),
    ("alert_freeze", -0.55, 0.7, 1.1, True),
]

# Kind, valence, arousal, concerning.
VOICE = [
    ("yelp", -0.85, 0.9, True), ("growl", -0.65, 0.55, True), ("whine", -0.4, 0.5, False), ("howl", -0.25, 0.5, False), ("bark_alarm", -0.4, 0.8, True),
    ("bark_excited", 0.3, 0.8, False), ("bark", -0.05, 0.7, False), ("pant", 0.0, 0.4, False), ("sound", 0.0, 0.3, False), ("speech", 0.0, 0.2, False),
]
NOT_THE_DOG = ["sound", "speech"]
VOICE_KINDS = [k for k, *_ in VOICE if k not in NOT_THE_DOG]


def affect_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AFFECT, "behaviour string, valence double, arousal double, weight double, stress boolean")


def voice_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOICE, "kind string, valence double, arousal double, concerning boolean")


def label_dim(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(idx, name, is_posture, is_arousal_flag) of a label space; names must be unique and not empty."""
    names = list(names or POSTURES + ACTIONS)
    if not names or len(set(names)) < len(names) or not all(names):
        raise ValueError("a label space needs unique, non-empty names")
    rows = [(i, n, n in POSTURES, n in AROUSAL_FLAGS) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "idx int, name string, is_posture boolean, is_arousal_flag boolean")
