"""Ordered scans that do not gather a key, or the whole table, in one task.

Rows are cut into buckets along the order.  A window runs within each bucket, one small row a bucket
is carried over from those before it, and both are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 128
#: Orders (turns, numbers of calls) in one bucket.
BUCKET_ORDERS = 1 << 16

#: Names of columns and whether they rise.
Order = list[tuple[str, bool]]


def bucket_of(order: str, width: int = BUCKET_ORDERS) -> Column:
    """Bucket of a whole number, such as a turn: a short key has one, a hot one as many as it needs."""
    return F.floor(F.col(order) / width)


def _sorted_by(order: Order, back: bool = False) -> list[Column]:
    return [F.col(c).asc() if rises != back else F.col(c).desc() for c, rises in order]


def accumulated(df: DataFrame, keys: list[str], order: Order, running: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """``df`` (with ``__bucket``) and sums of the same keys: ``running`` ones up to and including each row, ``totals``
    over all rows.  Only one row a bucket is summed up over a whole key; null keys are a key too."""
    own = Window.partitionBy(*keys, "__bucket").orderBy(*_sorted_by(order)).rowsBetween(Window.unboundedPreceding, 0) if running else None
    named = {f"__s{i}": v for i, v in enumerate([*running.values(), *totals.values()])}
    rows = df.select("*", *(v.alias(k) for k, v in named.items()))
    sums = rows.groupBy(*keys, "__bucket").agg(*(F.sum(k).alias(k) for k in named))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    carried = sums.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, "__bucket"])),
        *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__c{k}") if i < len(running) else F.sum(k).over(every).alias(f"__c{k}") for i, k in enumerate(named)),
    )
    for k in list(named)[:len(running)]:
        rows = rows.withColumn(f"__r{k}", F.sum(k).over(own))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, "__bucket"])]
    out = [(F.col(f"__r{k}") + F.col(f"__c{k}")).alias(n) for k, n in zip(named, running, strict=False)]
    out += [F.col(f"__c{k}").alias(n) for k, n in zip(list(named)[len(running):], totals, strict=True)]
    return rows.join(carried, same).select(*df.columns, *out)


def halo(df: DataFrame, keys: list[str], order: Order, bucket: Column, before: int) -> DataFrame:
    """``df`` with ``__bucket`` and ``__halo``: besides each bucket's rows, copies (``__halo``) of the up to ``before``
    rows of the same keys that come before them.  A window over keys and bucket whose frames reach no further
    back is then right in all rows but the copies, and no key is one task.  ``bucket`` must not fall along the order."""
    rows = df.withColumn("__bucket", bucket)
    back = Window.partitionBy(*keys, "__bucket").orderBy(*_sorted_by(order, back=True))
    ends = rows.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= before)
    item = F.struct("__n", F.struct(*df.columns).alias("row"))
    tails = ends.groupBy(*keys, "__bucket").agg(F.array_sort(F.collect_list(item), lambda a, b: b["__n"] - a["__n"]).alias("__t"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(-before, -1)
    held = tails.select("__bucket", F.flatten(F.collect_list("__t").over(earlier)).alias("__h"))
    last = F.when(F.size("__h") > before, F.slice("__h", -before, before)).otherwise(F.col("__h"))
    copies = held.select("__bucket", F.explode(last).alias("__c")).select("__c.row.*", "__bucket", F.lit(True).alias("__halo"))
    return rows.withColumn("__halo", F.lit(False)).unionByName(copies)


def quantile_bucket(df: DataFrame, value: Column, n: int = BUCKETS) -> DataFrame:
    """``df`` with ``__bucket``: how many of ``n - 1`` quantiles of ``value`` are below it."""
    cuts = df.agg(F.percentile_approx(value, F.array(*(F.lit(i / n) for i in range(1, n))), F.lit(10_000)).alias("__cuts"))
    joined = df.crossJoin(F.broadcast(cuts))  # one row
    return joined.withColumn("__bucket", F.coalesce(F.size(F.filter("__cuts", lambda c: c < value)), F.lit(-1))).drop("__cuts")


def _carried(df: DataFrame, keys: list[str], summary: Column, carry: Column) -> DataFrame:
    sums = df.groupBy(*keys, "__bucket").agg(summary.alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, "__bucket", carry.over(before).alias("__carry"))


def running_sum(df: DataFrame, value: Column, order: list[Column], out: str = "running", keys: list[str] | None = None) -> DataFrame:
    """``out``: the sum of ``value`` up to and including each row.  ``df`` has ``__bucket``, which must
    not fall along the order; it is dropped."""
    keys = keys or []
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("__own", F.sum(value).over(own))
    join = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__bucket")]
    carried = _carried(df, keys, F.sum(value), F.sum("__sum"))
    return (
        rows.alias("l").join(carried.alias("r"), join)
        .select(*(F.col(f"l.{c}") for c in df.columns if c != "__bucket"), (F.col("__own") + F.coalesce("__carry", F.lit(0))).alias(out))
    )


def rank(df: DataFrame, value: str, ties: list[Column], out: str = "rank", descending: bool = True) -> DataFrame:
    """``out``: place from 1 in the order of ``value``, equal ones by ``ties``."""
    key = -F.col(value) if descending else F.col(value)
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return running_sum(quantile_bucket(df, key), F.lit(1).cast("bigint"), [first, *ties], out)


def last_before(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, out: str = "prior") -> DataFrame:
    """``out``: the last value that is not null strictly before each row of the same keys.  ``bucket`` cuts
    the order, for example ``ts`` by the day."""
    df = df.withColumn("__bucket", bucket).withColumn("__value", value)
    own = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__own", F.last("__value", ignorenulls=True).over(own))
    place = F.struct(*order)
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), place))
    carried = _carried(df, keys, last, F.last("__sum", ignorenulls=True))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, "__bucket")]
    joined = rows.alias("l").join(carried.alias("r"), same, "left")
    return joined.select(*(F.col(f"l.{c}") for c in df.columns if not c.startswith("__")), F.coalesce("__own", "__carry").alias(out))
