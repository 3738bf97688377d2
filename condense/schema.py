"""Schemas of the tables that operators consume."""

from __future__ import annotations

from pyspark.sql import types as T




BLOBS = (
    "hash STRING NOT NULL, size BIGINT NOT NULL, created_at BIGINT NOT NULL, last_ref BIGINT NOT NULL, content_at DOUBLE, session STRING, kind STRING, workspace STRING, source STRING, "
    "command STRING, file_path STRING, search_pattern STRING, file_mtime DOUBLE, file_size BIGINT, file_ctime DOUBLE, dir_mtime DOUBLE, dir_size BIGINT, dir_ctime DOUBLE, "
    "edited_by_model BOOLEAN, full_file BOOLEAN, real_path STRING, seq BIGINT"
)
CONTENTS = "hash STRING NOT NULL, content STRING"
SNAPSHOT = "path STRING NOT NULL, mtime DOUBLE, size BIGINT, ctime DOUBLE"
TOOL_OUT = "call_id BIGINT NOT NULL, session STRING, tool STRING, command STRING, path STRING, is_error BOOLEAN, exit_code INT, content STRING, ts TIMESTAMP_NTZ"
MESSAGES = "conv_id BIGINT NOT NULL, turn BIGINT NOT NULL, role STRING, content STRING, is_error BOOLEAN, is_summary BOOLEAN"
EVENTS = "v INT, t TIMESTAMP, session STRING, level STRING, type STRING, action STRING, payload STRING"
USAGES = "session STRING, turn BIGINT, model STRING, input_tokens BIGINT, output_tokens BIGINT, cache_read BIGINT"
PRICES = "id STRING, input_per_m DOUBLE, output_per_m DOUBLE, cache_read_per_m DOUBLE"
POSTINGS = "term STRING, id STRING, tf BIGINT"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
