"""Declared schemas; no reader in this library infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# A line of a batch file. ``body`` as STRING keeps the text exactly as stored.
EVENT_LINE = T.StructType(_strings("id", "type", "body"))

# The same line for exports: typed JSON, and the fields an event without a body may carry itself.
EXPORT_LINE = T.StructType(
    [*_strings("id", "type"), *(T.StructField(n, T.VariantType()) for n in ("body", "input", "output"))]
)

EVENT_COLUMNS = (
    "event_id", "event_type", "timestamp", "project_id", "model", "name", "trace_id", "session_id", "body",
)

TRACE = T.StructType(
    [
        *_strings("id", "name"),
        T.StructField("timestamp", T.TimestampType()),
        *_strings("sessionId"),
        *(T.StructField(n, T.VariantType()) for n in ("input", "output", "metadata")),
        T.StructField("tags", T.ArrayType(T.StringType())),
        *(T.StructField(n, T.DoubleType()) for n in ("latency", "totalCost")),
        T.StructField("usage", T.VariantType()),
        *_strings("project_id"),
    ]
)

MEDIA_META = T.StructType(
    [
        T.StructField("contentType", T.StringType()),
        T.StructField("contentLength", T.LongType()),
        T.StructField("uploadedAt", T.StringType()),
    ]
)


def no_rows(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """An empty table of a schema; the optimizer sees that it is empty and nothing runs."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    nothing = (F.lit(None).cast(field.dataType).alias(field.name) for field in schema)
    return spark.sql("SELECT 1 AS one WHERE false").select(*nothing)
