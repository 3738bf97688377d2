"""Columns over JSON payloads of calls and usage records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col

INPUT_CHARS = 200


def pruned_input(value: ColumnOrName, chars: int = INPUT_CHARS) -> Column:
    """The beginning of a call's input as JSON; a text is taken as it is."""
    c = col(value)
    return F.left(c if isinstance(value, str) and value.endswith("_json") else F.to_json(c), F.lit(chars))


def first_number(json: ColumnOrName, *aliases: str, default: float = 0.0) -> Column:
    """The first of several fields of a JSON object that holds a finite number (dots lead into objects); a
    number in quotes is none."""
    v = F.try_parse_json(col(json))
    found = []
    for a in aliases:
        x = F.try_variant_get(v, f"$.{a}", "double")
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{a}", "variant"))
        number = kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)") & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
        found.append(F.when(number, x))
    return F.coalesce(*found, F.lit(default))


def usage(json: ColumnOrName) -> Column:
    """Struct ``input_tokens, output_tokens, cache_read`` of a usage record, whatever its provider calls them."""
    n = lambda *names: first_number(json, *names).cast("bigint")
    return F.struct(
        n("input_tokens", "prompt_tokens", "inputTokens", "promptTokens").alias("input_tokens"),
        n("output_tokens", "completion_tokens", "outputTokens", "completionTokens").alias("output_tokens"),
        n("cache_read_input_tokens", "cache_read", "cached_tokens", "prompt_tokens_details.cached_tokens", "cacheReadTokens").alias("cache_read"),
    )


def playbook_entries(json: ColumnOrName) -> Column:
    """Entries of a saved playbook ``{"playbook": [...]}``, field by field: an entry without a path goes, and
    a field of another type counts as missing."""
    items = F.try_variant_get(F.try_parse_json(col(json)), "$.playbook", "array<variant>")
    text = lambda v, f: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) == "STRING", F.try_variant_get(v, f"$.{f}", "string"))

    def number(v: Column, f: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
        return F.coalesce(F.when(kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{f}", "double")), F.lit(0.0)).cast("bigint")

    def entry(v: Column) -> Column:
        stale = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.stale", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.stale", "boolean")), F.lit(False))
        return F.struct(
            text(v, "path").alias("path"), text(v, "ref").alias("ref"), number(v, "helpful").alias("helpful"), number(v, "harmful").alias("harmful"),
            number(v, "lastAt").alias("last_at"), stale.alias("stale"),
        )

    return F.filter(F.transform(items, entry), lambda e: F.coalesce(e["path"], F.lit("")) != "")
