"""Passages of words that several documents share, by winnowing.

Words are runs of characters other than ASCII white space. Of every ``length`` - ``noise`` + 1 consecutive strings of ``noise``
words the one with the least hash is selected (the first of equals). Two documents that share ``length`` words in a row select
an equal string there; documents that share no ``noise`` words in a row never do.

The strings are written once, summed to the least and greatest document of each before they are shuffled, and joined back
to those that have two; a string that a third of all documents holds is one row on its side of that join.

Edge cases: a null text, or one of fewer than ``length`` words, shares nothing; repeated rows of one key are one document,
whose strings count once per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrowio import as_bytes, bounded, slices
from spanloom.llm.common import saved
from spanloom.llm.textnum import NOT_SPACE, Powers, byte_values, mix, sliding_least, span_hashes, windows, word_bounds

LENGTH, NOISE = 50, 32
LOW = np.uint64((1 << 30) - 1)


def selected(hashes: np.ndarray, counts: np.ndarray, length: int, noise: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the selected strings, from the word hashes of texts and their numbers of words."""
    grams, per_text = windows(hashes, counts, noise)
    width = length - noise + 1
    if len(grams) < width:
        return grams[:0], np.zeros(0, np.int64)
    key = mix(grams) & ~LOW | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(key, width) & LOW).astype(np.int64)
    ends = np.cumsum(per_text)
    of = np.repeat(np.arange(len(counts)), per_text)
    start = np.arange(len(at))
    at = at[start + width <= ends[of[: len(at)]]]
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    return grams[at], of[at]


def shared_strings(docs: DataFrame, length: int = LENGTH, noise: int = NOISE) -> DataFrame:
    """docs(uid binary, text) -> uid, n_shared long: selected strings that other documents have too, for those that have some."""

    def run(batches):
        powers, values = Powers(), byte_values(17)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, offsets = as_bytes(batch.column(1).slice(a, b - a))
                starts, ends, counts = word_bounds(flat, offsets, NOT_SPACE)
                grams, of = selected(span_hashes(flat, starts, ends, values, powers), counts, length, noise)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(of)).cast(pa.binary()), pa.array(grams.view(np.int64))], ["uid", "gram"])

    rows = saved(bounded(docs.select("uid", "text")).mapInArrow(run, "uid binary, gram long"), "strings")
    one = F.xxhash64("uid")
    several = rows.groupBy("gram").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("gram")
    return rows.join(several, "gram").groupBy("uid").agg(F.count("*").alias("n_shared"))
