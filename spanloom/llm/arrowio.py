"""Arrow helpers for operators that run numpy on the executors: text chunks, output batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Spark's limit on an Arrow batch, and the bytes that the operators here set unless the session has its own.
BATCH_LIMIT, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20
#: Text bytes that one numpy pass holds at a time; its temporaries take about 60 times as much.
CHUNK = 1 << 18


def slices(array: pa.Array, limit: int = CHUNK):
    """(start, stop) row ranges of a string array of at most ``limit`` bytes each, or one row."""
    offsets = np.frombuffer(array.buffers()[1], np.int32 if array.type == pa.string() else np.int64)[array.offset : array.offset + len(array) + 1]
    start = 0
    while start < len(array):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(stop, len(array))
        start = stop


def as_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes uint8, offsets int64) of a string array, from offset 0; null is empty."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def bounded(df: DataFrame) -> DataFrame:
    """The frame, with the session's Arrow batches bounded, so that long texts do not make large ones."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, BATCH_DEFAULT) == BATCH_DEFAULT:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    return df
