"""Readers and writers of the store: index files, folders of texts, Parquet tables."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import detect, redact

MOST_FILE_BYTES, MOST_DIR_ENTRIES = 1 << 20, 5000


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an index file ``{"rev": n, "blobs": [...]}`` in their order."""
    fields = [f for f in schema.struct(schema.BLOBS).fields if f.name != "seq"]
    row = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields)
    raw = spark.read.schema(f"rev BIGINT, blobs ARRAY<STRUCT<{row}>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode("blobs").alias("seq", "b")).select("b.*", F.col("seq").cast("bigint"))


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Contents of a folder with a file each, named by SHA-256; files whose name is another are dropped."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9a-f]{64})", 1).alias("hash"), F.col("value").alias("content"), F.unix_millis("_metadata.file_modification_time").alias("created_at"))
    return raw.where(F.sha2(F.col("content").cast("binary"), 256) == F.col("hash"))


def rebuild(contents: DataFrame, session: str = "") -> DataFrame:
    """Index rows for contents without an index."""
    return contents.select(
        "hash", F.length("content").cast("bigint").alias("size"), "created_at", F.col("created_at").alias("last_ref"), F.col("created_at").cast("double").alias("content_at"),
        F.lit(session).alias("session"), F.when(detect.is_binary("content"), "binary").otherwise("text").alias("kind"), F.lit("").alias("workspace"), F.lit("").alias("source"),
    )


def load(spark: SparkSession, index: str, folder: str, session: str = "") -> DataFrame:
    """The rows of an index file, or, where that is missing, broken or empty, those made anew from the folder's files."""
    try:
        rows = read_index(spark, index).where("hash is not null")
        if not rows.isEmpty():
            return rows
    except AnalysisException:
        pass
    return rebuild(read_folder(spark, folder), session)


def write(store: DataFrame, path: str) -> None:
    """A version of the store; readers see it when its job has committed."""
    store.write.mode("errorifexists").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(contents: DataFrame, hashes: list[str]) -> DataFrame:
    """Contents by hash; the filter reaches the Parquet scan."""
    return contents.where(F.col("hash").isin(*hashes))


def exists(contents: DataFrame, hashes: DataFrame) -> DataFrame:
    """``hash, exists`` of each asked hash."""
    own = contents.select("hash").distinct().withColumn("__there", F.lit(True))
    return hashes.select("hash").distinct().join(own, "hash", "left").select("hash", F.col("__there").isNotNull().alias("exists"))


def listing(contents: DataFrame) -> DataFrame:
    """``hash, size, created_at`` of all contents."""
    return contents.select("hash", F.length("content").cast("bigint").alias("size"), "created_at")


def without(contents: DataFrame, hashes: DataFrame) -> DataFrame:
    """What is left when contents are deleted."""
    return contents.join(hashes.select("hash").distinct(), "hash", "left_anti")


def consistent(files: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose time and size are those of a listing (``path, mtime, size``) made after they were read;
    what was written in between is dropped."""
    a = after.select("path", F.col("mtime").alias("__m"), F.col("size").alias("__s"))
    return files.join(a, "path").where((F.col("mtime") == F.col("__m")) & (F.col("size") == F.col("__s"))).drop("__m", "__s")


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """Text files up to a size, decoded as UTF-8 or UTF-16 by their mark; empty and binary ones are dropped."""
    raw = spark.read.format("binaryFile").load(path).where((F.col("length") > 0) & (F.col("length") <= most_bytes))
    first2, first3 = F.hex(F.substring("content", 1, 2)), F.hex(F.substring("content", 1, 3))
    text = (
        F.when(first2 == "FFFE", F.decode(F.substring("content", 3, most_bytes), "UTF-16LE"))
        .when(first3 == "EFBBBF", F.decode(F.substring("content", 4, most_bytes), "UTF-8"))
        .when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    )
    out = raw.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), text.alias("content"))
    return out.where(F.col("content").isNotNull() & ~detect.is_binary("content"))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, mtime, size`` of all files that a path or glob names, in any store that Spark reads; contents are
    not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``path, mtime, size, ctime`` of the files below a folder of this machine, as only its own file system
    tells change times; see :func:`listed_files` for shared stores."""
    rows = []
    for folder, _, names in os.walk(root):
        for name in names:
            s = os.stat(p := os.path.join(folder, name))
            rows.append((p, s.st_mtime_ns / 1e6, s.st_size, s.st_ctime_ns / 1e6))
    return spark.createDataFrame(rows, schema.struct(schema.SNAPSHOT))


def folder_signature(files: DataFrame, most: int = MOST_DIR_ENTRIES) -> DataFrame:
    """``path, mtime, size, ctime`` of folders: latest times and number of all files below; none for folders
    with more than ``most``."""
    up = F.regexp_replace("path", "/[^/]*$", "")
    parts = F.split(up, "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda p: p != "")
    rows = files.select(F.explode(above).alias("path"), "mtime", "ctime")
    return rows.groupBy("path").agg(F.max("mtime").alias("mtime"), F.count("*").alias("size"), F.max("ctime").alias("ctime")).where(F.col("size") <= most)


def export(spark: SparkSession, path: str, config: dict, blobs: DataFrame, events: DataFrame) -> None:
    """A bundle of JSON lines: the settings, the index, and event lines without secrets."""
    head = spark.createDataFrame([("config", json.dumps(config))], "part string, body string")
    index = blobs.select(F.lit("blob").alias("part"), F.to_json(F.struct(*(c for c in blobs.columns if c != "content"))).alias("body"))
    lines = events.select(F.lit("event").alias("part"), redact.redact(F.to_json(F.struct(*events.columns)))["text"].alias("body"))
    head.unionByName(index).unionByName(lines).write.mode("errorifexists").json(path)
