"""JSON text and VARIANT helpers.

VARIANT gives typed access but sorts object keys; where the printed text must keep the
order of the source, the text itself is carried next to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Closes the wrapping array, so that text after the first JSON value makes the parse fail.
_END = "~end~"


def _wrapped(text: Column) -> Column:
    return F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))


def json_valid(text: Column) -> Column:
    """Whether the text is exactly one JSON value."""
    items = F.from_json(_wrapped(text), "array<string>", {"allowSingleQuotes": "false"})
    return F.coalesce(F.slice(items, 2, 2) == F.array(F.lit(_END)), F.lit(False))


def _may_be_json(text: Column) -> Column:
    """Whether the text begins as JSON does. Most text that is not JSON is told apart by that, without a parser that fails."""
    return F.rlike(text, F.lit(r'^[ \t\r\n]*([\[{"0-9-]|true|false|null)'))


def body_or_empty(text: Column) -> Column:
    """The body as stored, or ``{}`` when it is null or not JSON."""
    return F.when(json_valid(text), text).otherwise(F.lit("{}"))


def with_variant(df: DataFrame, name: str, text: Column) -> DataFrame:
    """Add ``name``: the text parsed to VARIANT, or null unless it is exactly one JSON value.

    Two projections: the first parses, the second looks at the result twice. Spark keeps them
    apart because the parse is costly, so every text is parsed once. Text that is JSON but repeats a key is
    an error unless ``spark.sql.variant.allowDuplicateKeys`` is set, which keeps the last value.
    """
    lost = F.concat(F.lit("JSON repeats a key; set spark.sql.variant.allowDuplicateKeys: "), F.left(text, F.lit(200)))
    raw = f"_{name}_wrapped"
    return (
        df.withColumn(raw, F.when(_may_be_json(text), F.try_parse_json(_wrapped(text))))
        .withColumn(
            name,
            F.when(
                F.try_variant_get(raw, "$[1]", "string") == _END,
                F.try_variant_get(raw, "$[0]", "variant"),
            ).when(F.col(raw).isNull() & _may_be_json(text) & json_valid(text), F.raise_error(lost).cast("variant")),
        )
        .drop(raw)
    )


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """A part of a VARIANT, null when the path or the type does not fit."""
    return F.try_variant_get(value, path, kind)


def truthy(value: Column) -> Column:
    """Whether a script would take the VARIANT for true; null is false.

    Lists and objects are true, text unless it is empty, numbers unless they are zero. Nothing is printed.
    """
    number = at(value, "$", "double")
    return (
        F.when(value.isNull() | F.is_variant_null(value), F.lit(False))
        .when(is_list(value) | is_object(value), F.lit(True))
        .when(is_text(value), as_text(value) != "")
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_list(value: Column) -> Column:
    return at(value, "$", "array<variant>").isNotNull()


def is_object(value: Column) -> Column:
    return at(value, "$", "map<string,variant>").isNotNull()


def as_text(value: Column) -> Column:
    """A VARIANT string without quotes; other values as JSON text."""
    return at(value, "$", "string")


def content_text(value: Column, source: Column | None = None) -> Column:
    """Message content flattened to one line of text.

    Text stays as it is. In a list every part gives its ``text``, else its ``content``, else
    its JSON; the pieces are joined by blanks. Anything else is printed as JSON. ``source`` is
    the JSON text the value came from and keeps its key order in what is printed.
    """
    source = F.to_json(value) if source is None else source
    printed = F.from_json(source, "array<string>")

    def piece(part: Column, part_source: Column) -> Column:
        text, content = at(part, "$.text"), at(part, "$.content")
        return (
            F.when(truthy(text), as_text(text))
            .when(truthy(content), as_text(content))
            .when(is_text(part), F.to_json(part))
            .otherwise(F.coalesce(part_source, F.lit("null")))
        )

    pieces = F.zip_with(at(value, "$", "array<variant>"), printed, piece)
    return (
        F.when(is_list(value), F.array_join(pieces, " "))
        .when(value.isNull() | F.is_variant_null(value), F.lit(""))
        .when(is_text(value), as_text(value))
        .otherwise(source)
    )
