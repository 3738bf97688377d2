"""Dimension tables: prices and model windows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_S = 6 * 3600
# Parts of a price table's HTML.
ROW, CELL, STRUCK, TAG = r"(?is)<tr[^>]*>(.*?)</tr>", r"(?is)<t[dh][^>]*>(.*?)</t[dh]>", r"(?is)<(?:s|del|strike)(?:\s[^>]*)?>.*?</(?:s|del|strike)>", r"(?s)<[^>]+>"


def prices_json(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """A saved price list ``{"data": [{"id", "pricing": {"prompt", "completion", "input_cache_read"}}]}``, prices
    a token as text; negative and unreadable ones are dropped.  With ``only``, models whose name or its
    last part is one of these (in any case)."""
    raw = spark.read.schema("data ARRAY<STRUCT<id: STRING, pricing: STRUCT<prompt: STRING, completion: STRING, input_cache_read: STRING>>>").option("multiLine", True).json(path)
    p = raw.select(F.explode("data").alias("d"))
    per_m = lambda c: F.col(f"d.pricing.{c}").try_cast("double") * 1e6
    rows = p.select(F.col("d.id").alias("id"), per_m("prompt").alias("input_per_m"), per_m("completion").alias("output_per_m"), per_m("input_cache_read").alias("cache_read_per_m"))
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0)
    if only is not None:
        name, wanted = F.lower("id"), {x.lower() for x in only} | {x.lower().rsplit("/", 1)[-1] for x in only}
        rows = rows.where(name.isin(*wanted) | F.element_at(F.split(name, "/"), -1).isin(*wanted))
    return rows.where(F.col("id").isNotNull() & fine("input_per_m") & fine("output_per_m")).withColumn("cache_read_per_m", F.when(fine("cache_read_per_m"), F.col("cache_read_per_m")))


def table_rows(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, row, cells``: the cells of every table row without tags and struck-through text."""
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(ROW), F.lit(1))).alias("row", "tr"))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, STRUCK, ""), TAG, " "), r"\s+", " "))
    return rows.select("id", "row", F.transform(F.regexp_extract_all("tr", F.lit(CELL), F.lit(1)), plain).alias("cells"))


def prices_html(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Prices from HTML tables of model, input and output; a row without a model takes the one above it."""
    from pyspark.sql import Window

    money = lambda i: F.regexp_extract(F.try_element_at("cells", F.lit(i)), r"\$?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    rows = table_rows(pages, id_col, html_col).where(F.size("cells") >= 3)
    name = F.nullif(F.lower(F.try_element_at("cells", F.lit(1))), F.lit(""))
    w = Window.partitionBy("id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("model", F.last(name, ignorenulls=True).over(w))
    return filled.select("id", "row", "model", money(2).alias("input_per_m"), money(3).alias("output_per_m")).where("model is not null and input_per_m is not null and output_per_m is not null")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """``provider, model, context_limit`` of ``{provider: {"models": {name: {"limit": {"context": n}}}}}``."""
    raw = spark.read.text(path, wholetext=True)
    providers = F.from_json("value", "MAP<STRING, STRUCT<models: MAP<STRING, STRUCT<limit: STRUCT<context: BIGINT>>>>>")
    models = raw.select(F.explode(providers).alias("provider", "p")).select("provider", F.explode("p.models").alias("model", "m"))
    return models.select(F.lower("provider").alias("provider"), F.lower("model").alias("model"), F.col("m.limit.context").alias("context_limit")).where("context_limit > 0")


class Cached:
    """A dimension that is loaded anew when it is older than ``ttl_s``."""

    def __init__(self, load, ttl_s: float = TTL_S, clock=time.time):
        self.load, self.ttl_s, self.clock, self.at, self.value = load, ttl_s, clock, None, None

    def get(self) -> DataFrame:
        if self.at is None or self.clock() - self.at > self.ttl_s:
            self.value, self.at = self.load(), self.clock()
        return self.value
