"""Event, index and chat-dataset exports.

The row count comes from the write itself, so nothing is computed twice. An existing target
is an error unless another save mode is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.messages import to_messages


# ISO time with all microseconds; the writer's own default keeps milliseconds.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _write(df: DataFrame, path: str, mode: str, fmt: str = "json") -> int:
    written = Observation()
    counted = df.observe(written, F.count(F.lit(1)).alias("rows"))
    # A null field is written as null.
    options = TIME_FORMATS | {"ignoreNullFields": "false"} if fmt == "json" else {}
    counted.write.mode(mode).format(fmt).options(**options).save(path)
    return written.get["rows"]


def _typed_body(df: DataFrame) -> DataFrame:
    """Body text as JSON, so that it is written as an object and not as quoted text."""
    if "body" not in df.columns or not isinstance(df.schema["body"].dataType, T.StringType):
        return df
    return df.withColumn("body", F.coalesce(F.try_parse_json("body"), F.col("body").cast("variant")))


def export_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Events, one JSON object per line."""
    return _write(_typed_body(df), path, mode)


def export_catalog(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """The full events of a selection. One object per line: a single array would not split.

    Rows of ``read_records`` are written as the records they hold.
    """
    if "record" in df.columns:
        return _write(df.select(F.to_json("record")), path, mode, "text")
    return export_jsonl(df, path, mode)


def export_index(df: DataFrame, path: str, *, with_key: bool = True, mode: str = "errorifexists") -> int:
    """Locations of a manifest, ``{key, url}`` or only ``{url}``."""
    return _write(df.select("key", "url") if with_key else df.select("url"), path, mode)


def export_dataset(df: DataFrame, path: str, *, body_col: str = "body", mode: str = "errorifexists") -> int:
    """Conversations of at least two messages, ``{messages: [{role, content}, ...]}``."""
    return _write(to_messages(df, body_col).select("messages"), path, mode)
