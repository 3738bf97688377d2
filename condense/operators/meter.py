"""Metering: usage, cost, token estimates, calibration, growth, session folds."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching, ordered, scan

CACHE_SHARE = 0.1
#: Rows of a dimension (model names, prices, windows, settings) that may be broadcast.
MOST_NAMES = 20_000
DAY_S = 86_400


def usage_stats(usages: DataFrame, *by: str) -> DataFrame:
    """Sums and ratios of token counts; ratios are null without input."""
    i, c = F.sum("input_tokens"), F.sum("cache_read")
    return usages.groupBy(*by).agg(
        F.count("*").alias("requests"), i.alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), c.alias("cache_read"),
        (c / F.nullif(i, F.lit(0))).alias("cache_ratio"), F.sum(F.greatest(F.col("input_tokens") - F.col("cache_read"), F.lit(0))).alias("fresh_input"),
    )


def bounded(rows: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """The same rows; reading more than ``most`` of them is an error."""
    n = rows.agg(F.count("*").alias("__n"))
    fine = F.when(F.col("__n") <= most, True).otherwise(F.raise_error(F.lit(f"more than {most} rows in a dimension")).cast("boolean"))
    return rows.crossJoin(F.broadcast(n)).where(fine).drop("__n")  # one row


def normalise(model: Column) -> Column:
    return F.trim(F.lower(model))


def match_models(ids: DataFrame, prices: DataFrame, id_col: str = "model") -> DataFrame:
    """The price row of each distinct model name: equal names, then equal last parts, then one in the other
    (needles of three or more characters).  Both sides are dimensions, and that is checked: more than
    ``MOST_NAMES`` distinct names or prices are an error.  Names are walked through an automaton of all price names'
    last parts, and price names through one of all names', so no name is held against every price."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    names = ids.select(F.col(id_col)).where(F.col(id_col).isNotNull()).distinct().withColumn("__n", normalise(F.col(id_col))).withColumn("__nl", last(F.col("__n")))
    p = prices.where("id is not null").withColumn("__p", normalise(F.col("id"))).withColumn("__pl", last(F.col("__p")))
    long = lambda found: [x for x in found if len(x) >= 3]
    theirs = long(matching.dimension(p, "__pl", MOST_NAMES))
    own = long(matching.dimension(names, "__nl", MOST_NAMES))
    row = F.struct("id", "input_per_m", "output_per_m", "cache_read_per_m").alias("row")
    priced = p.select("__p", "__pl", row)
    found = [
        names.join(priced, F.col("__n") == F.col("__p")).select(id_col, F.lit(1).alias("place"), "row"),
        names.join(priced, F.col("__nl") == F.col("__pl")).select(id_col, F.lit(2).alias("place"), "row"),
        matching.hits(names, "__n", theirs, [id_col]).join(priced, F.col("string") == F.col("__pl")).select(id_col, F.lit(3).alias("place"), "row"),
        matching.hits(priced, "__p", own, ["row"]).join(names, F.col("string") == F.col("__nl")).select(id_col, F.lit(4).alias("place"), "row"),
    ]
    pairs = functools.reduce(DataFrame.unionByName, found)
    best = pairs.groupBy(id_col).agg(F.min_by("row", F.struct("place", "row.id")).alias("r"))
    return best.select(id_col, F.col("r.id").alias("price_id"), "r.input_per_m", "r.output_per_m", "r.cache_read_per_m")


def cost(usages: DataFrame, prices: DataFrame) -> DataFrame:
    """``usages`` with ``cost``: fresh input, output and cached input at a million tokens' price; cached
    input at a tenth of the input price unless given."""
    priced = usages.join(match_models(usages, prices), "model", "left")
    fresh = F.greatest(F.col("input_tokens") - F.col("cache_read"), F.lit(0))
    cached = F.coalesce("cache_read_per_m", F.col("input_per_m") * CACHE_SHARE)
    total = (fresh * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m") + F.col("cache_read") * cached) / 1e6
    return priced.select(*usages.columns, "price_id", total.alias("cost"))


def window_of(usages: DataFrame, catalog: DataFrame, default: int = 128_000) -> DataFrame:
    """``usages`` with ``context_limit``: by full name, by provider and name, by short name, else the default."""
    catalog = bounded(catalog)
    full = catalog.groupBy(F.concat_ws("/", "provider", "model").alias("__k")).agg(F.max("context_limit").alias("__full"))
    short = catalog.groupBy(F.element_at(F.split("model", "/"), -1).alias("__k")).agg(F.max("context_limit").alias("__short"))
    name = F.lower(F.trim("model"))
    rows = usages.withColumn("__m", name).withColumn("__s", F.element_at(F.split(name, "/"), -1))
    rows = rows.join(F.broadcast(full).withColumnRenamed("__k", "__m"), "__m", "left").join(F.broadcast(short).withColumnRenamed("__k", "__s"), "__s", "left")
    return rows.select(*usages.columns, F.coalesce(F.nullif("__full", F.lit(0)), F.nullif("__short", F.lit(0)), F.lit(default)).cast("bigint").alias("context_limit"))


def override(base: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Per-model settings over general ones, field by field."""
    o = bounded(overrides).select(F.lower("model").alias("__k"), *(F.col(f).alias(f"__{f}") for f in fields))
    rows = base.withColumn("__k", F.lower(F.trim("model"))).join(F.broadcast(o), "__k", "left")
    short = o.groupBy(F.element_at(F.split("__k", "/"), -1).alias("__k2")).agg(*(F.first(f"__{f}").alias(f"__2{f}") for f in fields))
    rows = rows.withColumn("__k2", F.element_at(F.split("__k", "/"), -1)).join(F.broadcast(short), "__k2", "left")
    return rows.select(*(F.coalesce(f"__{c}", f"__2{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def ols(samples: DataFrame, *by: str) -> DataFrame:
    """Least squares of ``tokens`` on ``ascii`` and ``cjk``: one pass of sums, then a closed form.  With no CJK
    at all the fit has one regressor; zeros for under three samples or a singular system."""
    a, c, t = (F.col(x).cast("double") for x in ("ascii", "cjk", "tokens"))
    sums = {"n": F.count("*").cast("double"), "a": F.sum(a), "c": F.sum(c), "t": F.sum(t), "aa": F.sum(a * a), "cc": F.sum(c * c), "tt": F.sum(t * t), "ac": F.sum(a * c), "at": F.sum(a * t), "ct": F.sum(c * t)}
    s = samples.groupBy(*by).agg(*(v.alias(f"s_{k}") for k, v in sums.items()))
    n, sa, sc, st, saa, scc, stt, sac, sat, sct = (F.col(f"s_{k}") for k in sums)
    # centred sums
    xaa, xcc, xac, xat, xct, xtt = saa - sa * sa / n, scc - sc * sc / n, sac - sa * sc / n, sat - sa * st / n, sct - sc * st / n, stt - st * st / n
    det = xaa * xcc - xac * xac
    two = (n >= 3) & (scc > 0) & (det > 1e-9 * xaa * xcc)
    one = (n >= 3) & (scc == 0) & (xaa > 0)
    slope = F.when(two, (xat * xcc - xct * xac) / det).when(one, xat / xaa).otherwise(0.0)
    cjk = F.when(two, (xct * xaa - xat * xac) / det).otherwise(0.0)
    level = F.when(two | one, (st - slope * sa - cjk * sc) / n).otherwise(0.0)
    rest = F.when(two | one, F.greatest(F.lit(0.0), xtt - slope * xat - cjk * xct)).otherwise(0.0)
    return s.select(*by, n.cast("bigint").alias("samples"), slope.alias("slope_ascii"), cjk.alias("slope_cjk"), level.alias("intercept"), rest.alias("residual_sum"))


def running_ratio(samples: DataFrame, key: str, order: str, chars: str = "chars", tokens: str = "tokens", memory: int = 32) -> DataFrame:
    """Characters a token after each key's samples: a running mean that turns into an exponential one
    after ``memory`` samples.  Blocks of a key are functions of the mean before them; samples without characters or tokens count nothing."""

    good = samples.where((F.col(chars) > 0) & (F.col(tokens) > 0))
    return scan.last(good, key, [order], scan.RunningMean(chars, tokens, memory), "samples bigint, chars_per_token double")


def running_estimates(samples: DataFrame, key: str, order: str, memory: int = 32, fitted: int = 200, least: int = 5) -> DataFrame:
    """Characters a token at every sample (``ascii, tokens``, whole numbers): ``samples, chars_per_token`` by
    :func:`running_ratio`, ``fitted, slope, intercept`` by least squares over the last ``fitted`` samples, and
    ``estimate``: the slope's inverse where ``least`` samples give a positive one, else the mean.  Samples
    without characters or tokens are left out."""
    good = samples.where((F.col("ascii") > 0) & (F.col("tokens") > 0))
    mean = scan.scan(good, key, [order], scan.RunningMean("ascii", "tokens", memory))
    both = scan.scan(mean, key, [order], scan.RollingFit("ascii", "tokens", fitted))
    return both.withColumn("estimate", F.when((F.col("fitted") >= least) & (F.col("slope") > 0), 1 / F.col("slope")).otherwise(F.col("chars_per_token")))


def calibrate(samples: DataFrame, key: str, order: str, memory: int = 32, fitted: int = 200, least: int = 5) -> DataFrame:
    """Characters a token of each key: by :func:`running_ratio`, or, from ``least`` samples on, by least squares
    over the last ``fitted`` ones if their slope is positive.  ``samples``: ``ascii, cjk, tokens``."""
    good = samples.where((F.col("ascii") + F.col("cjk") > 0) & (F.col("tokens") > 0)).withColumn("chars", F.col("ascii") + F.col("cjk"))
    mean = running_ratio(good, key, order, memory=memory)
    fit = ols(last_n(good, key, order, fitted), key).where(F.col("samples") >= least)
    both = mean.join(fit.select(key, F.col("samples").alias("fitted"), "slope_ascii", "slope_cjk", "intercept", "residual_sum"), key, "left")
    return both.withColumn("chars_per_token", F.when(F.col("slope_ascii") > 0, 1 / F.col("slope_ascii")).otherwise(F.col("chars_per_token")))


def commitment_meter(reports: DataFrame, at: str = "at", samples: int = 20, each: int = 3) -> DataFrame:
    """One row of sums over reports ``at, total, preserved, missed array<string>``: ``checks, atoms, preserved,
    missed, samples``, the last the newest ``samples`` of what was missed, at most ``each`` a report."""
    some = reports.where("total > 0")
    sums = some.agg(F.count("*").alias("checks"), F.coalesce(F.sum("total"), F.lit(0)).alias("atoms"), F.coalesce(F.sum("preserved"), F.lit(0)).alias("preserved"), F.coalesce(F.sum(F.size("missed")), F.lit(0)).alias("missed"))
    items = some.where(F.size("missed") > 0).select(F.col(at).alias("at"), F.posexplode(F.slice("missed", 1, each)).alias("place", "item"))
    newest = items.orderBy(F.desc("at"), F.desc("place"), F.desc("item")).limit(samples)
    last = newest.agg(F.array_sort(F.collect_list(F.struct("at", "place", F.left("item", F.lit(120)).alias("item")))).alias("samples"))
    return sums.crossJoin(last)  # one row each


def calibration_bins(samples: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, confidence, accuracy, gap`` of every bin of equal width, empty ones too.  ``samples``:
    ``confidence, hit``."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(0.9999), F.col("confidence")))
    got = samples.where("confidence is not null").groupBy(F.floor(c * bins).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("confidence"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    every = samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "confidence", "accuracy", F.abs(F.col("confidence") - F.col("accuracy")).alias("gap"))


def ece(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error: the bins' gaps weighted by their samples."""
    return calibration_bins(samples, bins).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def growth(usages: DataFrame, key: str = "session", order: str = "turn", span: int = 10) -> DataFrame:
    """Each request with ``growth`` (mean rise of input over the last ``span`` requests) and ``cache_ratio``
    over the same."""
    w = Window.partitionBy(key, "__bucket").orderBy(order)
    last = w.rowsBetween(-(span - 1), 0)
    rows = ordered.halo(usages, [key], [(order, True)], ordered.bucket_of(order), span).withColumn("__rise", F.col("input_tokens") - F.lag("input_tokens").over(w))
    first = F.row_number().over(w) == 1
    # the rise into the frame's first request is not part of the frame
    frame = w.rowsBetween(-(span - 2), 0)
    rise = F.when(first, 0.0).otherwise(F.coalesce(F.avg("__rise").over(frame), F.lit(0.0)))
    ratio = F.sum("cache_read").over(last) / F.nullif(F.sum("input_tokens").over(last), F.lit(0))
    return rows.withColumn("growth", rise).withColumn("cache_ratio", ratio).where(~F.col("__halo")).drop("__rise", "__bucket", "__halo")


def cache_dips(usages: DataFrame, key: str = "session", order: str = "turn", drop: float = 0.15) -> DataFrame:
    """Each request with its cache ratio and whether that fell by more than ``drop``."""
    w = Window.partitionBy(key, "__bucket").orderBy(order)
    own = usages.withColumn("ratio", F.col("cache_read") / F.nullif("input_tokens", F.lit(0)))
    rows = ordered.halo(own, [key], [(order, True)], ordered.bucket_of(order), 1)
    return rows.withColumn("dip", F.coalesce(F.lag("ratio").over(w) - F.col("ratio") > drop, F.lit(False))).where(~F.col("__halo")).drop("__bucket", "__halo")


def session_snapshot(events: DataFrame, key: str = "session", kind: str = "type", at: str = "t", kinds: list[str] | None = None) -> DataFrame:
    """Conditional counters and last values of each session's events, one combined aggregate."""
    own = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds or []]
    return events.groupBy(key).agg(F.count("*").alias("events"), *own, F.min(at).alias("started"), F.max(at).alias("last_at"), F.max_by(kind, at).alias("last_kind"))


def followed_by(calls: DataFrame, tool: str = "recall", then: tuple[str, ...] = ("read_file",), key: str = "session", order: str = "seq") -> DataFrame:
    """Calls of ``tool`` with ``followed``: the session's next call is one of ``then``."""
    w = Window.partitionBy(key, "__bucket").orderBy(F.desc(order))
    rows = ordered.halo(calls, [key], [(order, False)], -ordered.bucket_of(order), 1).withColumn("__next", F.lag("tool").over(w))
    own = rows.where(~F.col("__halo") & (F.col("tool") == tool))
    return own.withColumn("followed", F.coalesce(F.col("__next").isin(*then), F.lit(False))).drop("__next", "__bucket", "__halo")


def playbook(touches: DataFrame, n: int = 24) -> DataFrame:
    """Paths by how often they helped: ``path, helpful, harmful, last_at``.  ``touches``: ``path, helped, at``."""
    rows = touches.groupBy("path").agg(F.count_if("helped").alias("helpful"), F.count_if(~F.col("helped")).alias("harmful"), F.max("at").alias("last_at"))
    return rows.orderBy(F.desc("helpful"), F.desc("last_at"), "path").limit(n)


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """A ring buffer: the last ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def active_within(mentions: DataFrame, key: list[str], at: str, ttl_s: int = 300) -> DataFrame:
    """Each mention with ``still``: the same thing was mentioned within the time before it."""
    seconds = F.col(at).cast("timestamp").cast("double")
    w = Window.partitionBy(*key, "__bucket").orderBy(seconds)
    rows = ordered.halo(mentions, key, [(at, True)], F.floor(seconds / DAY_S), 1)
    still = F.coalesce(seconds - F.lag(seconds).over(w) <= ttl_s, F.lit(False))
    return rows.withColumn("still", still).where(~F.col("__halo")).drop("__bucket", "__halo")


def live_sessions(beats: DataFrame, now: Column, key: str = "session", at: str = "t", grace_s: int = 30) -> DataFrame:
    """Last heartbeat of each session and whether it is within the grace time."""
    last = beats.groupBy(key).agg(F.max(at).alias("last_at"))
    return last.withColumn("alive", F.unix_micros(F.col("last_at").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - grace_s * 1_000_000)


def reduction_report(rows: DataFrame, kind: str, before: str, after: str) -> DataFrame:
    """Characters before and after by kind, with a total (null kind)."""
    pct = F.round(100.0 * (F.sum(before) - F.sum(after)) / F.nullif(F.sum(before), F.lit(0)), 1)
    return rows.rollup(kind).agg(F.count("*").alias("items"), F.sum(before).alias("before"), F.sum(after).alias("after"), pct.alias("saved_pct"))
