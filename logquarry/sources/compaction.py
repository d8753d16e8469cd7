"""Many small batch files as one Parquet table of events, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import key_fields
from ..schemas import EVENT_LINE
from .files import metadata_key, tenant_folder
from .inventory import LAYOUT, layout_of

BROKEN = "broken"


def _names(schema: T.StructType) -> list[T.StructField]:
    return [T.StructField("event_key" if field.name == "key" else field.name, field.dataType) for field in schema]


def compact_files(
    spark: SparkSession,
    root: str,
    path: str,
    checkpoint: str,
    project_id: str | None = None,
    *,
    is_org_admin: bool = False,
    extra: T.StructType | None = None,
    files_at_once: int = 10_000,
) -> int:
    """Append the events of batch files that were not there at the last run; returns how many lines there were.

    A file stream with its own ``checkpoint`` reads every file once, and its sink commits a batch of files as a whole, so a run that breaks
    off neither loses nor repeats a line. The table holds the events as ``read_events`` has them, with the body's text as
    stored and the ``extra`` fields, by ``org`` and ``day``; lines that are not JSON are kept in ``broken``. Files of other names are
    left out.
    """
    schema = T.StructType([*EVENT_LINE, *(extra or []), T.StructField(BROKEN, T.StringType())])
    lines = (
        spark.readStream.format("json")
        .schema(schema)
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_at_once)
        # A late file is old by its own clock; none may be left out.
        .option("maxFileAge", "36500d")
        .load(tenant_folder(root, project_id, is_org_admin))
        .withColumnRenamed("key", "event_key")
        .withColumn("key", metadata_key(root))
    )
    run = (
        lines.where(key_fields(F.col("key"))["timestamp"].isNotNull())
        .withColumns(layout_of(F.col("key")))
        .observe("compacted", F.count(F.lit(1)).alias("lines"))
        .writeStream.format("parquet")
        .partitionBy(*LAYOUT)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return sum(progress.observedMetrics["compacted"]["lines"] for progress in run.recentProgress if progress.observedMetrics)


def _stored(spark: SparkSession, path: str, extra: T.StructType | None) -> DataFrame:
    own = [T.StructField(name, T.StringType()) for name in (BROKEN, "key", LAYOUT[0])]
    return spark.read.schema(T.StructType([*_names(T.StructType([*EVENT_LINE, *(extra or [])])), *own, T.StructField(LAYOUT[1], T.DateType())])).parquet(path)


def read_compacted(spark: SparkSession, path: str, *, extra: T.StructType | None = None) -> DataFrame:
    """The events of a compacted table as ``read_events`` has them, and ``org, day``; lines that are not JSON are left out.

    ``extra`` names the fields that are wanted of those that were kept.
    """
    return _stored(spark, path, extra).where(F.col(BROKEN).isNull()).drop(BROKEN)


def broken_compacted(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of each file were not JSON: ``key, broken``, as ``broken_lines`` counts them."""
    lines = _stored(spark, path, None).where(F.col(BROKEN).isNotNull())
    return lines.groupBy("key").agg(F.count(F.lit(1)).alias("broken"))
