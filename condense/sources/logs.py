"""Event logs as newline-delimited JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schema

LEVELS = ["debug", "info", "warn", "error"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of all files that a path or glob names; malformed lines are dropped."""
    return spark.read.schema(schema.struct(schema.EVENTS)).option("mode", "DROPMALFORMED").json(path).where("type is not null")


def stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema.struct(schema.EVENTS)).option("maxFilesPerTrigger", files_per_trigger).json(path).where("type is not null")


def at_least(level: Column, threshold: str) -> Column:
    """Whether a level is at or above a threshold; unknown levels are not."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)) > LEVELS.index(threshold)


def append(events: DataFrame, path: str, level: str = "info") -> None:
    events.where(at_least(F.col("level"), level)).write.mode("append").json(path)


def sink(events: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds", level: str = "info") -> list[StreamingQuery]:
    """Append a stream of events to a log: warnings and errors as soon as they come, the rest in batches ``every`` so often.  With
    ``every=None`` both take what is there and end."""
    kept = events.where(at_least(F.col("level"), level))
    urgent = at_least(F.col("level"), "warn")
    out = []
    for name, rows, often in (("urgent", kept.where(urgent), "0 seconds"), ("batched", kept.where(~urgent), every)):
        writer = rows.writeStream.format("json").option("path", f"{path}/{name}").option("checkpointLocation", f"{checkpoint}/{name}")
        out.append(writer.trigger(**({"availableNow": True} if every is None else {"processingTime": often})).start())
    return out


def stats(spark: SparkSession, path: str) -> DataFrame:
    """Files, lines and bytes of a log."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count("*").alias("lines")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))


def older_than(spark: SparkSession, path: str, days: int) -> DataFrame:
    """Files that a pruning would delete."""
    rows = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    return rows.where(F.col("modificationTime") < F.current_timestamp() - F.make_interval(days=F.lit(days)))


def prune(spark: SparkSession, path: str, days: int) -> int:
    """Delete the files that :func:`older_than` names and return how many; their names (not their lines)
    reach the driver one partition at a time."""
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for r in older_than(spark, path, days).select("path").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(p.getFileSystem(conf).delete(p, False))
    return n


def clear(spark: SparkSession, path: str) -> None:
    """Delete a log folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
