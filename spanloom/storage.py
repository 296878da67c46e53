"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables written and not yet deleted, oldest first.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder; on a local master else a temporary one.

    A cluster without either raises, as a folder of the driver's machine would lose the executors' rows.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    kept = context._jsc.sc().getCheckpointDir()
    if not found and kept.isDefined():
        found = kept.get()
    elif not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    if not kept.isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: lineage ends there, and no executor's loss undoes it.

    The table stays until release(), the end of a scratch() around the call, or the driver's end.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


def _at_exit() -> None:
    session = SparkSession.getActiveSession()
    if session is not None and session.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):  # the folder's owner may clean up after a driver that dies
            release(session)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for what a caller writes itself; deleted like saved() tables."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit)
    _written.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Deletes the table of a frame that saved() returned; frames made from it cannot be read any more."""
    path = getattr(df, "_spanloom_path", None)
    if path in _written:
        _written.remove(path)
        delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes every table that saved() has written: for callers that have taken or written their results."""
    while _written:
        delete(spark, _written.pop())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the tables written within, but for those of frames put into the list that it gives."""
    before, keep = set(_written), []
    try:
        yield keep
    finally:
        kept = {getattr(df, "_spanloom_path", None) for df in keep}
        for path in [p for p in _written if p not in before and p not in kept]:
            _written.remove(path)
            delete(spark, path)
