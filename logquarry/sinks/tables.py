"""Event tables and traces as Parquet that is laid out for time ranges and for lookups of single ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import comparable, iso_utc

# Columns that are asked for by single values. Each row group has a Bloom filter for them.
EVENT_IDS = ("event_id", "trace_id", "session_id", "input_hash")
TRACE_IDS = ("id", "sessionId")
# Bytes in a row group, and the different values of an id that its filter is made for.
GROUP_BYTES, GROUP_IDS = 16 << 20, 100_000


def _lookup_options(df: DataFrame, ids: Sequence[str], group_bytes: int, group_ids: int) -> dict[str, str]:
    options = {"parquet.block.size": str(group_bytes), "parquet.bloom.filter.enabled": "false"}
    for name in ids:
        if name in df.columns:
            options[f"parquet.bloom.filter.enabled#{name}"] = "true"
            options[f"parquet.bloom.filter.expected.ndv#{name}"] = str(group_ids)
    return options


def utc_day(df: DataFrame, column: str) -> Column:
    """The UTC date of a time column, whatever the session's time zone."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.to_date(column)
    return F.left(iso_utc(comparable(df, column)), F.lit(10)).cast("date")


def write_event_table(
    df: DataFrame,
    path: str,
    *,
    mode: str = "errorifexists",
    group_bytes: int = GROUP_BYTES,
    group_ids: int = GROUP_IDS,
) -> None:
    """Write events by ``org`` and ``day``, in order of time, with Bloom filters on their ids.

    Searches then skip the partitions of other orgs and days (``org_col="org", date_col="day"``), and for an id the row groups whose
    filter rules it out; those of other times too, if instants are written with
    ``spark.sql.parquet.outputTimestampType=TIMESTAMP_MICROS``, as Spark keeps no bounds of its older format. Rows are dealt to tasks by ranges of org, day and time, so an org or a day
    that holds most rows is split. ``mode="append"`` adds to a table of the same layout.
    """
    layout = {"org": F.substring_index("project_id", "/", 1), "day": utc_day(df, "timestamp")}
    order = [*layout, "timestamp", "event_id"]
    dealt = df.withColumns(layout).repartitionByRange(*order).sortWithinPartitions(*order)
    options = _lookup_options(df, EVENT_IDS, group_bytes, group_ids)
    dealt.write.mode(mode).options(**options).partitionBy(*layout).parquet(path)


def write_traces(
    df: DataFrame,
    path: str,
    *,
    mode: str = "errorifexists",
    group_bytes: int = GROUP_BYTES,
    group_ids: int = GROUP_IDS,
) -> None:
    """Write trace records, such as landed JSON lines, by ``day`` and in order of time, with Bloom filters on their ids.

    ``scan_traces(..., fmt="parquet")`` reads them; a search for one trace opens the row groups whose filter may hold its id.
    """
    order = ["day", "timestamp", "id"]
    dealt = df.withColumn("day", utc_day(df, "timestamp")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode(mode).options(**_lookup_options(df, TRACE_IDS, group_bytes, group_ids)).partitionBy("day").parquet(path)
