"""Joins with tables that are meant to be small, checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """The frame marked for broadcast if it has at most ``most`` rows, else as it is, so that the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
