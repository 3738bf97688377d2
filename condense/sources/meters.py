"""Counters of a session and the mark of a purge, as one-row tables in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save(spark: SparkSession, path: str, values: dict[str, float]) -> None:
    """Replace the saved counters."""
    fields = T.StructType([T.StructField(k, T.DoubleType()) for k in sorted(values)])
    spark.createDataFrame([tuple(float(values[k]) for k in sorted(values))], fields).coalesce(1).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """One row of the named counters; what was never saved, or is no number, is 0."""
    zero = [F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    if not _there(spark, path):
        return spark.createDataFrame([(0.0,) * len(names)], schema)
    return spark.read.schema(schema).json(path).select(*zero)


def mark_purged(spark: SparkSession, path: str, at_ms: int) -> None:
    """Leave a mark that everything made up to now has been purged."""
    spark.createDataFrame([(at_ms,)], "purged_at bigint").coalesce(1).write.mode("append").json(path)


def purges(spark: SparkSession, path: str) -> DataFrame:
    """All marks, for :func:`condense.operators.store.after_purge`."""
    return spark.read.schema("purged_at bigint").json(path) if _there(spark, path) else spark.createDataFrame([], "purged_at bigint")
