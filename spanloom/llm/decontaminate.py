"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item gives windows of WINDOW consecutive words (a shorter item gives one window of all its words). A
window is a set of words that must be contained whole, so one prefix word is enough: with the words of a window ordered
by their frequency in the corpus, the rarest. Document words that are some window's prefix word give candidates; length
and position bounds discard those that stick out of the document, and the rest are verified word by word.

A hot word costs no pairs: of each window only the rarest word joins. The benchmark's side is broadcast when its word
count, known before, is at most ``broadcast_words``; above that the same join shuffles on the word, and each document
row then carries only the words around its position. Words join by a 64-bit hash; grams are compared as strings.
The words of the corpus are written once to the shared folder, since cutting text costs far more than reading words.

Edge cases: null or empty text has no words, n_hit 0 and the hash of an empty list; an item without words has no window;
items with a null id count as hits but are not listed; repeated documents each get their row; equal item ids are one item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import row_key, saved, words_of

WINDOW = 10
BROADCAST_WORDS = 200_000


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram array<string>, items array<string>): the distinct windows and the ids of the items that have them."""
    n = F.size("w")
    starts = F.sequence(F.lit(1), n - window + 1)
    grams = F.when(n >= window, F.transform(starts, lambda i: F.slice("w", i, window))).otherwise(F.array("w"))
    return (
        items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(grams).alias("gram"))
        .groupBy("gram")
        .agg(F.collect_set("item").alias("items"))
    )


def with_prefix(windows: DataFrame, docs: DataFrame, small: bool) -> DataFrame:
    """Adds to each window its rarest word by corpus frequency (ties: the lesser word) and that word's first offset."""
    hint = F.broadcast if small else (lambda x: x)
    vocabulary = windows.select(F.explode("gram").alias("word")).select(F.xxhash64("word").alias("k")).distinct()
    frequency = docs.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("k")).join(hint(vocabulary), "k", "left_semi")
    rarest = (
        windows.select("gram", F.explode(F.array_distinct("gram")).alias("word"))
        .withColumn("k", F.xxhash64("word"))
        .join(frequency.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
        .groupBy("gram")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "k")).alias("least"))
    )
    return rarest.join(windows, "gram").where("least.n > 0").select(
        F.col("least.k").alias("k"), (F.array_position("gram", F.col("least.word")) - 1).cast("int").alias("off"), "gram", "items"
    )


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> tuple[DataFrame, DataFrame]:
    """(every row's uid, doc_id, words; of the uids with hits their spans array<struct<start,len>>, items array<string>, n_hit).

    uid is the key of doc_id and text: repeated rows share it, and their hits; a null id or text differs from any string.
    """
    n_item_words = items.select(F.sum(F.size(words_of(F.col("text"))))).first()[0] or 0
    small = n_item_words <= broadcast_words
    keyed = saved(docs.select(row_key("doc_id", "text").alias("uid"), "doc_id", words_of(F.col("text")).alias("words")), "words")
    prefix = saved(with_prefix(item_windows(items, window), keyed, small), "prefix")
    placed = keyed.select("uid", "words", F.posexplode("words").alias("pos", "word")).withColumn("k", F.xxhash64("word"))
    size = F.size("gram")
    if small:
        found = placed.join(F.broadcast(prefix), "k").where(
            (F.col("pos") >= F.col("off"))
            & (F.col("pos") - F.col("off") + size <= F.size("words"))
            & (F.slice("words", F.col("pos") - F.col("off") + 1, size) == F.col("gram"))
        )
    else:
        first = F.greatest(F.col("pos") - window + 1, F.lit(0))
        around = placed.select("uid", "pos", "k", first.alias("first"), F.slice("words", first + 1, 2 * window - 1).alias("near"))
        start = F.col("pos") - F.col("off") - F.col("first")
        found = around.join(prefix, "k").where((start >= 0) & (F.slice("near", F.greatest(start, F.lit(0)) + 1, size) == F.col("gram")))
    hits = found.groupBy("uid").agg(
        F.array_sort(F.collect_set(F.struct((F.col("pos") - F.col("off")).alias("start"), size.alias("len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["len"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return keyed, hits.withColumn("n_hit", covered)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> uid, doc_id, n_words, n_hit, items array<string>, spans array<struct<start,len>>."""
    keyed, hits = find(docs, items, window, broadcast_words)
    return keyed.select("uid", "doc_id", F.size("words").cast("long").alias("n_words")).join(hits, "uid", "left").select(
        "uid",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,len:int>>")).alias("spans"),
    )


def op1(spark, sf_dir) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return decontaminate(read("documents"), read("benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
      FROM (SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT rid, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
      FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
m AS (SELECT rid, p.k, i, item FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
hit AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT rid, k, i FROM m)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
