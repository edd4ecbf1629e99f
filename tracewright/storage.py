"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``.

    Where neither is set, a local session gets a temporary folder and a cluster an error,
    as its machines share no such folder.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewright-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder's name, inside the innermost :func:`scratch` or, to ``keep``, the one around it."""
    around = _scratch.get()[: -1 if keep else None]
    return f"{around[-1] if around else shared_dir(spark) + '/tracewright'}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any of Hadoop's file systems, if it exists."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes when the block ends, unless it was written to keep.

    Nothing that outlives the block may still have to read it: what does is written inside
    with ``keep``.
    """
    path = new_path(spark, "scratch")
    token = _scratch.set((*_scratch.get(), path))
    try:
        yield
    finally:
        _scratch.reset(token)
        remove(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither repeat
    the work nor depend on any one executor."""
    path = new_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
