"""Row shapes: event envelope, file rows, trace rows, result previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonvals import as_text, at, body_or_empty, content_text, is_text, truthy, with_variant
from ..functions.times import iso_utc
from ..schemas import EVENT_COLUMNS

# What stands for a missing part of a preview, and how much of a text is shown.
MISSING = "-"
PREVIEW_LENGTH = 80


def project_events(df: DataFrame) -> DataFrame:
    """The nine columns of the event table."""
    return df.select(*EVENT_COLUMNS)


def envelope(df: DataFrame) -> DataFrame:
    """``id, type, timestamp, body``; a body that is not JSON becomes ``{}``."""
    return df.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("type"),
        "timestamp",
        body_or_empty(F.col("body")).alias("body"),
    )


def file_rows(df: DataFrame) -> DataFrame:
    """Key, its four ids and its time as ISO text."""
    return df.select(
        "key", "session_id", "trace_id", "trace_type", "input_hash", iso_utc(F.col("timestamp")).alias("timestamp")
    )


def _column_or(df: DataFrame, name: str, default: Column) -> Column:
    """A column, or the default where the table has none; a null that is there stays null."""
    return F.col(name) if name in df.columns else default


def _json_of(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("null")
    value = F.col(name)
    text = F.to_json(value) if isinstance(df.schema[name].dataType, T.VariantType) else value
    return F.coalesce(text, F.lit("null"))


def trace_body(df: DataFrame) -> Column:
    """Input, output and metadata of a trace as one JSON text.

    VARIANT columns are printed; STRING columns are taken to hold JSON text already.
    """
    return F.concat(
        F.lit('{"input":'), _json_of(df, "input"),
        F.lit(',"output":'), _json_of(df, "output"),
        F.lit(',"metadata":'), _json_of(df, "metadata"),
        F.lit("}"),
    )


def trace_rows(df: DataFrame) -> DataFrame:
    """Trace records in the shape of search results."""
    blank, nothing = F.lit(""), F.lit(None)
    trace_id = _column_or(df, "id", blank)
    no_tags = F.array().cast("array<string>")
    return df.select(
        trace_id.alias("id"),
        F.lit("trace").alias("type"),
        _column_or(df, "timestamp", blank).alias("timestamp"),
        trace_id.alias("trace_id"),
        _column_or(df, "sessionId", blank).alias("session_id"),
        _column_or(df, "name", blank).alias("name"),
        trace_body(df).alias("body"),
        F.coalesce(_column_or(df, "tags", no_tags), no_tags).alias("tags"),
        _column_or(df, "latency", nothing.cast("double")).alias("latency"),
        _column_or(df, "totalCost", nothing.cast("double")).alias("total_cost"),
        _column_or(df, "usage", nothing.cast("string")).alias("usage"),
    )


def _shown(value: Column) -> Column:
    return F.left(value, F.lit(PREVIEW_LENGTH))


def _decoded(df: DataFrame, part: str) -> DataFrame:
    """Columns for one part of the body: ``_{part}`` as it is there, and ``_{part}_json``, where a part that is text is
    decoded once more; null if that text is not JSON.
    """
    value, said = F.col(f"_{part}"), F.col(f"_{part}_said")
    df = df.withColumn(f"_{part}", at(F.col("_body"), f"$.{part}"))
    df = df.withColumn(f"_{part}_said", F.when(is_text(value), as_text(value)))
    df = with_variant(df, f"_{part}_told", said)
    return df.withColumn(f"_{part}_json", F.when(said.isNull(), value).otherwise(F.col(f"_{part}_told")))


def _source(part: str, path: Column | str = "") -> Column:
    """What stands at the path of a part, as JSON text with keys in their own order; text stands there without quotes.

    This parses the text again, so it belongs only where an object or a list is printed.
    """
    said, path = F.col(f"_{part}_said"), path if isinstance(path, Column) else F.lit(path)
    text = F.when(said.isNull(), F.col("_text")).otherwise(said)
    root = F.when(said.isNull(), F.lit(f"$.{part}")).otherwise(F.lit("$"))
    return F.call_function("get_json_object", text, F.concat(root, path))


def _with_input(df: DataFrame) -> DataFrame:
    """``_input_list``, the messages, and ``_input_part``, the content of the last of them.

    What several conditions look at has a column of its own, so that it is worked out once.
    """
    value = F.col("_input_json")
    own = at(value, "$", "array<variant>")
    df = df.withColumn("_input_own", own)
    df = df.withColumn("_input_list", F.coalesce("_input_own", at(value, "$.messages", "array<variant>")))
    return df.withColumn("_input_part", at(F.try_element_at("_input_list", F.lit(-1)), "$.content"))


def _input_preview() -> Column:
    value, size = F.col("_input_json"), F.size("_input_list")
    place = F.when(F.col("_input_own").isNotNull(), F.lit("[")).otherwise(F.lit(".messages["))
    last = content_text(F.col("_input_part"), _source("input", F.concat(place, (size - 1).cast("string"), F.lit("].content"))))
    return (
        F.when(~truthy(F.col("_input")), F.lit(MISSING))
        .when(value.isNull(), _shown(F.col("_input_said")))
        .when(size > 0, _shown(last))
        .when(is_text(value), _shown(as_text(value)))
        .otherwise(_shown(_source("input")))
    )


def _with_output(df: DataFrame) -> DataFrame:
    """``_output_choices``, whether there are any, the first one's message, and ``_output_part``, the content shown."""
    value, some = F.col("_output_json"), F.col("_output_choices")
    df = df.withColumn("_output_choices", F.coalesce(F.size(at(value, "$.choices", "array<variant>")) > 0, F.lit(False)))
    df = df.withColumn("_output_message", at(value, "$.choices[0].message"))
    return df.withColumn("_output_part", F.when(some, at(F.col("_output_message"), "$.content")).otherwise(at(value, "$.content")))


def _output_preview() -> Column:
    value, part, some = F.col("_output_json"), F.col("_output_part"), F.col("_output_choices")
    place = F.when(some, F.lit(".choices[0].message.content")).otherwise(F.lit(".content"))
    return (
        F.when(~truthy(F.col("_output")), F.lit(MISSING))
        .when(value.isNull(), _shown(F.col("_output_said")))
        .when(is_text(value), _shown(as_text(value)))
        .when(truthy(F.when(some, F.col("_output_message")).otherwise(part)), _shown(content_text(part, _source("output", place))))
        .otherwise(F.lit(MISSING))
    )


def preview(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Add ``model``, ``input_preview`` and ``output_preview`` read from the body text.

    A body that is missing or not JSON shows ``-`` in all three. A body is parsed once, a part that is text and holds
    JSON once more; what is printed as JSON is taken from the text, and only then is that read a second time.
    """
    columns = df.columns
    body = F.col(body_col)
    unquoted = F.when(F.startswith(F.ltrim(body), F.lit('"')), F.get_json_object(body, "$")).otherwise(body)
    df = with_variant(df.withColumn("_text", unquoted), "_body", F.col("_text"))
    df = _with_output(_with_input(_decoded(_decoded(df, "input"), "output")))
    model = at(F.col("_body"), "$.model")
    return df.select(
        *columns,
        F.when(truthy(model), as_text(model)).otherwise(F.lit(MISSING)).alias("model"),
        _input_preview().alias("input_preview"),
        _output_preview().alias("output_preview"),
    )
