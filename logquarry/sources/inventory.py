"""A stored inventory of batch files, so that finding files needs no listing.

The inventory is a Parquet table of ``key, length, modified`` laid out by ``org`` and ``day``, the first part of the key and the UTC date
of its stamp. Keys without a readable stamp have no day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import key_fields, with_key_meta
from ..functions.text import org_of
from ..functions.times import as_utc, iso_utc
from .files import metadata_key, read_events, shared_lookups, tenant_folder

LAYOUT = ("org", "day")
_OBJECT = "path string, modificationTime timestamp, length long, content binary"

# Keys are handled in slices: the first is small, as the newest files often hold enough, and each is twice the one before.
FIRST_FILES, MOST_FILES, MOST_BYTES = 64, 4096, 64 << 30


def layout_of(key: Column) -> dict[str, Column]:
    """The partition of the inventory that a key belongs to."""
    stamp = key_fields(key)["timestamp"]
    return {"org": F.substring_index(key, "/", 1), "day": F.left(iso_utc(stamp), F.lit(10)).cast("date")}


def update_inventory(
    spark: SparkSession,
    root: str,
    path: str,
    checkpoint: str,
    project_id: str | None = None,
    *,
    is_org_admin: bool = False,
    files_at_once: int = 100_000,
) -> int:
    """Append the objects that were not there at the last run; returns how many there were.

    A file stream with its own ``checkpoint`` remembers what it has seen, so every object is appended exactly once, also
    when a run breaks off. No object is opened. One stream lists one folder: the whole root, or
    that of a tenant or org with a checkpoint and path of its own. The listing passes the driver, as for every file
    stream; where that is too much, let the producers append the keys they write, in the same columns.
    """
    objects = (
        spark.readStream.format("binaryFile")
        .schema(_OBJECT)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_at_once)
        # A late file is old by its own clock; none may be left out.
        .option("maxFileAge", "36500d")
        .load(tenant_folder(root, project_id, is_org_admin))
        .select(
            metadata_key(root).alias("key"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    )
    with shared_lookups(spark):
        run = (
            objects.withColumns(layout_of(F.col("key")))
            .writeStream.format("parquet")
            .partitionBy(*LAYOUT)
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return sum(progress["numInputRows"] for progress in run.recentProgress)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, length long, modified timestamp, org string, day date").parquet(path)


def pruned(
    inventory: DataFrame, project_id: str, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """The partitions of an inventory, or of a table laid out like one, that may hold keys of the tenant in the time range."""
    if "org" in inventory.columns:
        inventory = inventory.where(F.col("org") == org_of(project_id))
    if "day" in inventory.columns:
        if start:
            inventory = inventory.where(F.col("day") >= F.lit(as_utc(start).date()))
        if end:
            inventory = inventory.where(F.col("day") <= F.lit(as_utc(end).date()))
    return inventory


def key_slices(
    keys: DataFrame, *, first: int = FIRST_FILES, most: int = MOST_FILES, most_bytes: int = MOST_BYTES
) -> Iterator[list[str]]:
    """The keys, newest first and then by name, in slices.

    ``keys`` has ``key, timestamp`` and perhaps ``length``. Spark sorts them, and the driver holds no more than a slice and one
    sorted partition.
    """
    sized = "length" in keys.columns
    ordered = keys.orderBy(F.col("timestamp").desc(), "key").select("key", *(["length"] if sized else []))
    some, size, files = [], 0, min(first, most)
    for row in ordered.toLocalIterator():
        if some and (len(some) >= files or size >= most_bytes):
            yield some
            some, size, files = [], 0, min(2 * files, most)
        some.append(row["key"])
        size += (row["length"] or 0) if sized else 0
    if some:
        yield some


def scan_slices(
    spark: SparkSession, root: str, keys: DataFrame, read: Callable[..., DataFrame] = read_events, **how
) -> Iterator[DataFrame]:
    """The contents of the files with the given keys, slice by slice, by exact paths.

    ``keys`` is a table with ``key`` and perhaps ``length``; keys that are not those of batch files are left out. No folder is listed, and a
    slice's paths are all that the driver holds at a time. ``read`` is one of the readers of files.
    """
    keys = with_key_meta(keys.select(*(name for name in ("key", "length") if name in keys.columns)))
    for some in key_slices(keys):
        yield read(spark, root, keys=some, **how)


def read_files(spark: SparkSession, root: str, keys: DataFrame, read: Callable[..., DataFrame] = read_events, **how) -> DataFrame:
    """The contents of the files with the given keys as one table; no other file is opened or looked up.

    The paths of all these files stay with the plan, on the driver; ``scan_slices`` goes through any number.
    """
    parts = list(scan_slices(spark, root, keys, read, **how))
    return reduce(DataFrame.unionByName, parts) if parts else read(spark, root, keys=[], **how)
