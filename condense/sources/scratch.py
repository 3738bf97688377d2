"""Shared scratch space: tables and files that the driver and all executors can see."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders made in the present scope; each thread (and task of a loop) has its own.
_scope: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new, not yet existing folder below ``spark.checkpoint.dir``; where that is unset, a local
    session (as in tests) sets a temporary folder up, and any other is told to set it."""
    root = spark.conf.get(KEY, None)
    if not root:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError(f"{KEY} must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="condense-"))
            checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = checkpoint.get()
    if "://" not in root and not root.startswith("file:"):
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        ).makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)).toString()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    if (made := _scope.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are :func:`stored` within are deleted at its end."""
    made: list[str] = []
    outer = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(outer)
        for path in made:
            drop_path(spark, path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing reads any more."""
    for t in tables:
        p, fs = _path(t.sparkSession, t.stored_at)
        fs.delete(p, True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`shared_dir`."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder."""
    p, fs = _path(spark, path)
    return fs.getContentSummary(p).getLength()


def put_file(spark: SparkSession, local: str, url: str) -> str:
    """Copy a file of the driver to the shared folder."""
    p, fs = _path(spark, url)
    fs.mkdirs(p.getParent())
    fs.copyFromLocalFile(_path(spark, f"file://{local}")[0], p)
    return url


def arrow_fs(uri: str):
    """The Arrow file system of a URI, and the path in it; used inside tasks, which have no JVM."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(uri)
