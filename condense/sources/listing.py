"""Metadata of files by tasks: folders are listed level by level, each by whatever executor has its row.

Executors see the folders themselves (a shared file system, or any that Arrow reads); nothing is listed by
the driver but whether a level has folders left.  Change times are known of ``file:`` paths only.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import MOST_DIR_ENTRIES
from .scratch import arrow_fs, stored

SCHEMA = "root string, path string, is_dir boolean, mtime double, size bigint, ctime double"
_TYPES = [pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.float64()]


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") else None


def _stat(root: str, path: str, local: str) -> tuple | None:
    try:
        s = os.stat(local)
    except OSError:
        return None
    return root, path, os.path.isdir(local), s.st_mtime_ns / 1e6, s.st_size, s.st_ctime_ns / 1e6


def _entries(root: str, path: str) -> Iterator[tuple]:
    """What a folder holds; nothing for one that cannot be read."""
    local = _local(path)
    if local is not None:
        try:
            names = sorted(os.listdir(local))
        except OSError:
            return
        for name in names:
            row = _stat(root, f"{path.rstrip('/')}/{name}", f"{local.rstrip('/')}/{name}")
            if row is not None:
                yield row
        return
    from pyarrow import fs as pafs

    files, inner = arrow_fs(path)
    for f in files.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        mtime = f.mtime_ns / 1e6 if f.mtime_ns is not None else None
        yield root, f"{path.rstrip('/')}/{f.base_name}", f.type == pafs.FileType.Directory, mtime, f.size or 0, None


def _listed(batches: Iterator[pa.RecordBatch], own: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist(), strict=True):
            if not own:
                rows.extend(_entries(root, path))
            elif (local := _local(path)) is not None and (row := _stat(root, path, local)) is not None:
                rows.append(row)
            elif _local(path) is None:
                rows.append((root, path, True, None, 0, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


def entries(roots: DataFrame, most: int = MOST_DIR_ENTRIES) -> DataFrame:
    """``root, path, is_dir, mtime, size, ctime`` of each of ``roots`` (``path``) and of all that is below it.  A root with more than ``most``
    entries is given up on at the level where that shows, and has then at least ``most + 1`` rows below it.  A root that
    is missing has no rows, a folder that cannot be read none below it.  Levels are written to the shared folder."""
    asked = roots.select(F.col("path").alias("root"), "path").where("path is not null").distinct()
    first = stored(asked.mapInArrow(functools.partial(_listed, own=True), SCHEMA), "listing")
    levels, open_ = [first], first.where("is_dir")
    cores = roots.sparkSession.sparkContext.defaultParallelism
    while not open_.isEmpty():
        # a level's folders are dealt out by name, as folders of one root may be very many
        level = stored(open_.select("root", "path").repartition(cores, "path").mapInArrow(functools.partial(_listed, own=False), SCHEMA), "listing")
        levels.append(level)
        every = functools.reduce(DataFrame.unionByName, levels[1:])
        over = every.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most)
        open_ = level.where("is_dir").join(over.select("root"), "root", "left_anti")
    return functools.reduce(DataFrame.unionByName, levels)


def signatures(roots: DataFrame, most: int = MOST_DIR_ENTRIES) -> DataFrame:
    """``path, mtime, size, ctime`` of each of ``roots`` (``path``) that is a folder with at most ``most`` entries at any depth:
    the latest times of itself and all of them, and their number."""
    rows = entries(roots, most)
    below = F.col("path") != F.col("root")
    found = rows.groupBy("root").agg(F.max("mtime").alias("mtime"), F.count_if(below).alias("size"), F.max("ctime").alias("ctime"), F.bool_or(~below & F.col("is_dir")).alias("folder"))
    return found.where(F.col("folder") & (F.col("size") <= most)).select(F.col("root").alias("path"), "mtime", "size", "ctime")


def snapshot(roots: DataFrame, most: int = 1 << 62) -> DataFrame:
    """``path, mtime, size, ctime`` of all files below ``roots``, as :func:`condense.sources.blobs.snapshot` lists one folder."""
    return entries(roots, most).where(~F.col("is_dir")).select("path", "mtime", "size", "ctime").distinct()
