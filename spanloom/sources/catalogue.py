"""A catalogue of public video data sets: what they hold, on which terms, and how their labels map to the label space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key string, repository string, gigabytes double, licence string, behaviours array<string>, label_map map<string,string>"
#: Key, repository, size, terms, behaviours, source label to own label.
DATASETS = [
    ("dog-behavior", "fishchen/dog-behavior-dataset", 9.5, "see its card", ["yawning", "eating_drinking", "eliminating", "playing", "chewing"], {"yawn": "yawning", "eating": "eating_drinking", "pooping": "eliminating", "toy": "playing", "rope": "chewing"}),
    ("animalkingdom", "Hzzone/Animal_Kingdom", 15.1, "research use", [], {}),
    ("mammalnet", "linxxx3/MammalNet", 159.0, "research use", [], {}),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DATASETS, SCHEMA)


def describe(rows: DataFrame, most: int = 100) -> str:
    """A text of the catalogue's first ``most`` rows."""
    return "\n\n".join(
        f"{r.key}: {r.repository}, {r.gigabytes:g} GB, {r.licence}" + (f"\n  behaviours: {', '.join(r.behaviours)}" if r.behaviours else "") for r in rows.orderBy("key").limit(most).collect()
    )


def download(key: str, folder: str) -> str:
    """Fetches a data set into a folder with the hub's own client, where that is installed; resumes what is there."""
    found = [d for d in DATASETS if d[0] == key]
    if not found:
        raise KeyError(f"no data set {key!r}")
    try:
        from huggingface_hub import snapshot_download
    except ImportError as error:
        raise RuntimeError("fetching needs the package huggingface_hub") from error
    return snapshot_download(found[0][1], repo_type="dataset", local_dir=folder)
