"""Bounded samples of labelled rows, taken without gathering a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def per_class(rows: DataFrame, class_col: str, id_col: str, size: int) -> DataFrame:
    """About ``size`` rows of each class, by a threshold on a hash of the id.

    Counts by class come first (from two columns only), then one pass keeps the rows below their
    class's threshold, so no class is gathered or sorted.  A class of at most ``size`` rows is
    kept whole.  The classes must be few: their counts reach the driver.
    """
    counts = rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count().collect()
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    keep = F.lit(False)
    for r in counts:
        share = min(1.0, size / r["count"])
        keep = keep | ((F.col(class_col) == F.lit(r[0])) & (place < int(share * (1 << 30))))
    return rows.where(keep)
