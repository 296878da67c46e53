"""What the operators share: the word expression and written tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.storage import saved, shared_dir

__all__ = ["ascii_lower", "one_row_each", "row_key", "saved", "shared_dir", "words_of"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words in text whose A-Z are lower-cased: ASCII other than 0-9 and a-z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter. Pure ASCII takes the built-in; other text is cut before each A-Z, whose first
    character is then translated, as translating every character is slow."""
    cut = F.transform(F.split(text, "(?=[A-Z])", -1), lambda p: F.concat(F.translate(F.left(p, F.lit(1)), UPPER, UPPER.lower()), F.substr(p, F.lit(2))))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.array_join(cut, ""))


def words_of(text: Column) -> Column:
    """array<string> of the words; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), "")


def row_key(*columns: str) -> Column:
    """128 bits that name a row by these columns; nulls and the ends of values count, so (null, 's') is not ('s', null)."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts.append(F.when(value.isNull(), F.lit("n")).otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.md5(F.concat(*parts)))


def one_row_each(rows: DataFrame, key: str = "uid") -> DataFrame:
    """A row per key, of rows that are equal where the key is: copies go before the shuffle, which joins by the key reuse."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(*[F.first(c).alias(c) for c in rest])
