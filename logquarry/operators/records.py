"""Whole records as typed columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_fields
from ..functions.text import matches

# Names in the text of a schema stand in back quotes where they could be taken for something else.
_PARTS = re.compile(r"`(?:[^`]|``)*`|OBJECT<>|OBJECT<|\bVOID\b")


def record_schema(records: DataFrame) -> T.StructType:
    """The fields that any of the records has, found by one pass that Spark spreads.

    Types that differ are widened: whole and fractional numbers to the larger kind, and what has no common type stays VARIANT, as do
    fields that are null throughout and objects without fields.
    """
    found = records.agg(F.schema_of_variant_agg("record")).head()[0]
    if not found or not found.startswith("OBJECT<"):
        return T.StructType([])
    types = {"OBJECT<>": "VARIANT", "OBJECT<": "STRUCT<", "VOID": "VARIANT"}
    ddl = _PARTS.sub(lambda part: types.get(part.group(), part.group()), found)
    if ddl == "VARIANT":
        return T.StructType([])
    return records.sparkSession.sql(f"SELECT CAST(NULL AS {ddl}) AS record").schema["record"].dataType


def typed_records(records: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """The records of ``read_records`` with a column for every field of any of them, and ``file_key``, their file's key.

    The schema is found first, unless one is given. A record that lacks a field, or whose value does not fit a given
    type, has null there.
    """
    schema = record_schema(records) if schema is None else schema
    return records.select(*(_field(field).alias(field.name) for field in schema), F.col("key").alias("file_key"))


def _field(field: T.StructField) -> Column:
    quote = '"' if '"' not in field.name else "'"
    if quote in field.name:  # no path can name it
        value = F.try_variant_get("record", "$", "map<string,variant>")[field.name]
    else:
        value = F.try_variant_get("record", f"$[{quote}{field.name}{quote}]", "variant")
    return value if isinstance(field.dataType, T.VariantType) else value.try_cast(field.dataType)


def search_records(records: DataFrame, q: str | None, *, wildcard: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """The records that hold the text in body, id or type, as typed columns and with ``file_timestamp``.

    A body is searched as it is printed, with sorted keys and no blanks between them. All records of ``records`` shape the
    columns, not only those found.
    """
    schema = record_schema(records) if schema is None else schema
    found = records
    if q and q != "*":
        body = F.variant_get("record", "$.body", "variant")
        holds = F.lit(False)
        for column in (F.to_json(body), F.col("id"), F.col("type")):
            holds = holds | F.coalesce(matches(column, q, wildcard=wildcard), F.lit(False))
        found = records.where(holds)
    typed = typed_records(found, schema)
    return typed.withColumn("file_timestamp", key_fields(F.col("file_key"))["timestamp"])
