"""Written cut points in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of local applications that name none.
_OWN: dict[str, str] = {}
#: Paths of the tables written within the innermost open `temporary`.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets a fresh one; a cluster, whose
    executors share no local folder, gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="spark-")
        _OWN[spark.sparkContext.applicationId] = path
    return path


def fresh(spark: SparkSession) -> str:
    """A path in that folder that nothing has used. It is deleted when the application ends, or its `temporary` does."""
    path = f"{folder(spark)}/lodestone/{uuid.uuid4().hex}"
    fs, p = files(spark, path)
    fs.deleteOnExit(p)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: later stages survive lost executors and joins see true sizes. Runs a job."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """df dealt by keys over tasks of about so many rows, however few partitions a session sets or joins small ones to: for steps that make many
    rows of one. Counts df, or a table `of` as many rows."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, -(-(df if of is None else of).count() // rows)), *keys)


@contextlib.contextmanager
def temporary(spark: SparkSession, keep: bool = False) -> Iterator[None]:
    """Tables cut inside are deleted at the end; whatever is still to be read must be written before, inside one more with keep."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        written = _WRITTEN.get()
        _WRITTEN.reset(token)
        for path in [] if keep else written:
            fs, p = files(spark, path)
            fs.delete(p, True)


def files(spark: SparkSession, path: str):
    """(file system, path) of a path of the cluster."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
