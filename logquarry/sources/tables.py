"""Wide event tables from the catalog, from files or over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_name(table: str, schema: str = "", catalog: str | None = None) -> str:
    """``schema.table``, or ``catalog.schema.table`` where a catalog is in play.

    With a catalog argument both other parts must be set, otherwise the bare table is meant.
    """
    if catalog is None:
        parts = [schema, table] if schema else [table]
    else:
        parts = [catalog, schema, table] if catalog and schema else [table]
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def scan_event_table(
    spark: SparkSession,
    table: str | None = None,
    *,
    schema: str = "",
    catalog: str | None = None,
    path: str | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """An event table by name, by Parquet path, or through JDBC options."""
    given = [source for source in (table, path, jdbc) if source]
    if len(given) != 1:
        raise ValueError("give exactly one of table, path and jdbc")
    if path:
        return spark.read.parquet(path)
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.table(table_name(table, schema, catalog))
