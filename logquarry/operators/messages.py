"""Chat messages out of event bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonvals import at, truthy, with_variant

# Fixed value: the fewest messages that make a conversation.
MIN_MESSAGES = 2


def _complete(message: Column) -> Column:
    return truthy(at(message, "$.role")) & truthy(at(message, "$.content"))


def _role_and_content(message: Column) -> Column:
    return F.struct(at(message, "$.role", "string").alias("role"), at(message, "$.content").alias("content"))


def conversation(sent: Column, received: Column) -> Column:
    """Input messages followed by the output message; messages without role or content are left out.

    ``sent`` is a list of messages or an object with such a list. ``received`` is a completion
    with choices, of which the first counts, or else a message itself.
    """
    asked = F.coalesce(at(sent, "$.messages", "array<variant>"), at(sent, "$", "array<variant>"))
    first_choice = at(received, "$.choices[0].message")
    has_choices = F.coalesce(F.size(at(received, "$.choices", "array<variant>")) > 0, F.lit(False))
    answer = F.when(has_choices, first_choice).otherwise(received)
    everything = F.concat(F.coalesce(asked, F.array().cast("array<variant>")), F.array(answer))
    return F.transform(F.filter(everything, _complete), _role_and_content)


def to_messages(df: DataFrame, body_col: str = "body") -> DataFrame:
    """Add ``messages`` and keep the rows that have at least two.

    The body is JSON text or VARIANT. Where it is missing and the rows carry VARIANT columns
    ``input`` and ``output`` (as ``read_export_events`` gives), those are used instead.
    """
    columns = df.columns
    body = F.col("_body")
    if isinstance(df.schema[body_col].dataType, T.VariantType):
        df = df.withColumn("_body", F.col(body_col))
    else:
        df = with_variant(df, "_body", F.col(body_col))
    sent, received = at(body, "$.input"), at(body, "$.output")
    if {"input", "output"} <= set(columns):
        sent = F.when(truthy(body), sent).otherwise(F.col("input"))
        received = F.when(truthy(body), received).otherwise(F.col("output"))
    # Exploding a list of zero or one conversations keeps or drops the row. A filter after a
    # projection would be pushed below it and make Spark build every conversation twice.
    kept = F.filter(F.array(conversation(sent, received)), lambda messages: F.size(messages) >= MIN_MESSAGES)
    return df.select(*columns, F.explode(kept).alias("messages"))
