"""Quality rules as a bitmask ledger: every rule is evaluated once per document, policies and ablations are bit arithmetic.

The ledger holds the measurements and ``failures``, a bitmask with one bit per rule. A policy is a version's set of rules;
applying it is ``failures & mask = 0``, so another policy or an ablation never reads a text again.

Words are the runs of characters other than ASCII white space. Repeated windows and lines are found by 64-bit hashes.

Edge cases: null and empty texts have no words and measurements 0; repeated rows each get their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowio import as_bytes, bounded, slices
from spanloom.llm.textnum import NOT_SPACE, Powers, byte_values, mix, span_hashes, windows, word_bounds

WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_same"]
#: The symbols counted by n_symbols, and the marks ! and ?.
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
MARKS = np.isin(np.arange(256), [ord(c) for c in "!?"])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LETTER = UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 0xC0)

#: Rules by bit: name and the condition under which a document fails. Integers only, so every engine agrees.
RULES = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "10 * word_chars < 25 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("shouting", "2 * n_upper > n_letters"),
    ("marks", "2 * n_marks > n_words"),
    ("stuttering", "2 * n_same > n_words"),
]
#: Policies by version: the names of the rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": [name for name, _ in RULES],
}
CURRENT = "v1"


def measure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the MEASURES as long, a row per row."""

    def run(batches):
        powers, exact = Powers(), byte_values(5)
        for batch in batches:
            text = batch.column(1)
            parts = [measured(text.slice(a, b - a), powers, exact) for a, b in slices(text)]
            columns = np.concatenate(parts, axis=1) if parts else np.zeros((len(MEASURES), 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns)], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def measured(texts: pa.Array, powers: Powers, exact: np.ndarray) -> np.ndarray:
    """int64 MEASURES x texts."""
    flat, offsets = as_bytes(texts)
    n = len(texts)
    starts, ends, counts = word_bounds(flat, offsets, NOT_SPACE)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    hashes = span_hashes(flat, starts, ends, exact, powers)
    grams, per_text = windows(hashes, counts, WINDOW)
    of = np.repeat(np.arange(n), per_text)
    first_word = np.cumsum(counts) - counts
    at = np.arange(len(grams)) - np.repeat(np.cumsum(per_text) - per_text, per_text) + first_word[of]
    _, which, times = np.unique(mix(grams + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    repeated = at[times[which] > 1]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, repeated, 1)
    np.add.at(edge, repeated + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    word_at = np.concatenate([[0], np.cumsum(counts)])
    n_repeat = covered[word_at[1:]] - covered[word_at[:-1]]

    breaks = np.flatnonzero(flat == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    line_text = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    line_ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    spoken = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    lines = span_hashes(flat, line_starts[spoken], line_ends[spoken], exact, powers)
    owner = line_text[spoken]
    _, first = np.unique(mix(lines + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    n_lines = np.bincount(owner, minlength=n)
    same = hashes[1:] == hashes[:-1]
    inner = np.ones(len(hashes) + 1, bool)
    inner[word_at] = False
    same_at = np.concatenate([[0], np.cumsum(np.concatenate([[False], same & inner[1:-1]]) if len(hashes) else np.zeros(0, bool))])
    n_dup = n_lines - np.bincount(owner[first], minlength=n)
    return np.stack(
        [counts, total(NOT_SPACE[flat] & ((flat & 0xC0) != 0x80)), total(SYMBOLS[flat]), n_dup, n_repeat, n_lines, total(LETTER[flat]), total(UPPER[flat]), total(MARKS[flat]), same_at[word_at[1:]] - same_at[word_at[:-1]]]
    ).astype(np.int64)


def mask_of(names: list[str]) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[n] for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the MEASURES and failures long."""
    bits: Column = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("failures", bits)


def passes(version: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask_of(POLICIES[version])).cast("long")) == 0


def ablation(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """Of a ledger: rule, n_failed, n_only (rejected by this rule alone) and kept_without (kept if the policy lacked it)."""
    mask = mask_of(POLICIES[version])
    counted = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    sums = []
    for name in POLICIES[version]:
        bit = F.lit(mask_of([name])).cast("long")
        has = F.col("f").bitwiseAND(bit) != 0
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("f") == bit, F.col("n"))), F.lit(0)).alias("n_only"),
                F.coalesce(F.sum(F.when(F.col("f").bitwiseAND(F.lit(mask - mask_of([name])).cast("long")) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
            )
        )
    return counted.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def op3(spark, sf_dir) -> DataFrame:
    rows = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"),
        (passes("base") & passes(CURRENT)).alias("kept"), "failures",
    )


def quality_ablation(spark, sf_dir) -> DataFrame:
    """What each rule of the current policy rejects, over all documents."""
    return ablation(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle() -> str:
    mask = " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES))
    count = lambda keep: f"length(regexp_replace(t, '{keep}', '', 'g'))"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS x
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({count(r'[\x20\x09-\x0D]')} AS BIGINT) AS word_chars,
      CAST({count(r'[^#*$%&|<>]')} AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
      coalesce(l.n, 0) AS n_lines, {count(r'[\x00-\x40\x5B-\x60\x7B-\x7F]')} AS n_letters, {count('[^A-Z]')} AS n_upper, {count('[^!?]')} AS n_marks,
      len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_same
      FROM w LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, CAST({mask} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask_of(POLICIES['base'])} <> 0 AS base_failed,
       failures & {mask_of(POLICIES[CURRENT]) | mask_of(POLICIES['base'])} = 0 AS kept, failures FROM f"""


ORACLE = _oracle()
_CURRENT = mask_of(POLICIES[CURRENT])
ABLATION_ORACLE = f"WITH q AS (SELECT failures & {_CURRENT} AS f FROM ({ORACLE})) " + " UNION ALL ".join(
    f"""SELECT '{name}' AS rule, count(*) FILTER (f & {mask_of([name])} <> 0) AS n_failed, count(*) FILTER (f = {mask_of([name])}) AS n_only,
    count(*) FILTER (f & {_CURRENT - mask_of([name])} = 0) AS kept_without FROM q"""
    for name in POLICIES[CURRENT]
)
