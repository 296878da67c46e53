"""Corpus cleaning pipeline: language, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns the columns of documents, the last one
those and the token columns. run() applies them in order; between stages the rows are written to the shared folder, and a
stage's own tables and its input are deleted when its rows are written.

Edge cases: rows with null or letterless text go in the first stage; a null doc_id or other null stays as it is, and a null
id differs from any string; of equal rows one stays; of documents in a class the least doc_id stays, nulls last; columns
whose names the operators use themselves pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, langid, near, secrets
from spanloom.llm.common import one_row_each, row_key, saved
from spanloom.operators.joins import small
from spanloom.storage import drop, scratch


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__uid", row_key("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no text, no letter, or a calibrated score under the threshold."""
    return langid.predict(docs, langid.fit(docs), "__").where("NOT __rejected").select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the document with the least doc_id, and one row of it."""
    kept = near.jaccard_classes(docs).where("uid = class_uid").select(F.col("uid").alias("__uid")).distinct()
    rows = docs.select(row_key("doc_id", "text").alias("__uid"), F.struct(*docs.columns).alias("__row"))
    return one_row_each(rows, "__uid").join(kept, "__uid", "left_semi").select("__row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window: any hit word counts, as a test passage of ten words is enough to leak."""
    _, hits = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = saved(hits.select(F.col("uid").alias("__uid")), "contaminated")
    return keyed(docs).join(small(found), "__uid", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret span by a mask; no document is dropped, and n_chars follows the text."""
    found = secrets.scan(docs, keep=docs.columns)
    masked = F.when(F.size("spans") > 0, secrets.redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    new = {"text": masked}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length(masked)).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token_ids, n_tokens and the digests of ids and decoded text."""
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as kept:
            docs = saved(stage(spark, before, sf_dir), f"stage-{name}")
            kept.append(docs)
        drop(before)
    return docs


#: Language models, class merging and BPE are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None
