"""Batch files of JSON lines: inventory of keys and reading of contents.

A *root* is the folder that holds all tenants. Keys are paths below it. Readers narrow the
listing to the tenant's own folder; filters on the key then keep every other file closed,
because Spark evaluates filters on file metadata before it opens a file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonvals import at
from ..functions.keys import key_fields
from ..functions.text import org_of, require_clean
from ..schemas import EVENT_LINE, EXPORT_LINE, no_rows

_GLOB_CHARACTERS = r"([\\{}\[\]*?])"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
_BROKEN = "_broken"
_LOOKUPS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _base_path(root: str) -> str:
    path = re.sub(_SCHEME, "", root)
    if not path.startswith("/"):
        raise ValueError(f"root must be an absolute path or a URI: {root!r}")
    return path.rstrip("/") + "/"


def key_below(root: str, path: Column) -> Column:
    """The part of a file path below the root."""
    return F.regexp_replace(path, _SCHEME + re.escape(_base_path(root)), "")


def metadata_key(root: str) -> Column:
    """The key of the file a row was read from.

    File metadata is percent-encoded; ``+`` is shielded because URL decoding would turn it
    into a blank.
    """
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return key_below(root, F.url_decode(encoded))


def tenant_prefix(project_id: str, is_org_admin: bool = False) -> str:
    """The key prefix a tenant may see; an admin of ``org/user`` sees all of ``org/``."""
    require_clean(project_id)
    return (org_of(project_id) if is_org_admin else project_id) + "/"


def tenant_folder(root: str, project_id: str | None, is_org_admin: bool = False) -> str:
    """The folder to list: the root, or the part of it that a tenant may see."""
    _base_path(root)
    if project_id is None:
        return root
    return f"{root.rstrip('/')}/{tenant_prefix(project_id, is_org_admin)}"


def exact_path(root: str, key: str) -> str:
    """The path of one object; characters that readers take for patterns stand for themselves."""
    return f"{root.rstrip('/')}/" + re.sub(_GLOB_CHARACTERS, r"\\\1", key)


@contextmanager
def shared_lookups(spark: SparkSession) -> Iterator[None]:
    """Within it Spark looks up given paths by a few tasks for each core, where it would start a task for each path."""
    before = int(spark.conf.get(_LOOKUPS, "10000"))
    spark.conf.set(_LOOKUPS, min(before, 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(_LOOKUPS, before)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name, in whatever store Spark reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def load_or_empty(
    spark: SparkSession, root: str, load: Callable[[], DataFrame], schema: T.StructType | str
) -> DataFrame:
    """The loaded files, or no rows of the same schema when a folder below the root does not exist.

    A root that does not exist is an error.
    """
    try:
        return load()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND" or not exists(spark, root):
            raise
        return no_rows(spark, schema)


def list_batches(
    spark: SparkSession, root: str, project_id: str | None = None, *, is_org_admin: bool = False
) -> DataFrame:
    """All objects below the root or below one tenant: ``key, length, modified``.

    Nothing is opened, and objects that a filter on the key rules out are not even looked up.
    """
    folder = tenant_folder(root, project_id, is_org_admin)

    def load() -> DataFrame:
        return (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(folder)
            .select(
                metadata_key(root).alias("key"),
                F.col("_metadata.file_size").alias("length"),
                F.col("_metadata.file_modification_time").alias("modified"),
            )
        )

    return load_or_empty(spark, root, load, "key string, length long, modified timestamp")


def _usable(key: str = "key") -> Column:
    """Whether the key is one of a batch file: media and other files are not events and are not opened."""
    return key_fields(F.col(key))["timestamp"].isNotNull()


def _read_lines(
    spark: SparkSession, root: str, place: str | Sequence[str], fields: T.StructType, strict: bool
) -> DataFrame:
    """The lines of a folder, or of the files with the given keys; such a file must exist."""
    schema = T.StructType([*fields, T.StructField(_BROKEN, T.StringType())])
    reader = spark.read.schema(fields if strict else schema).option("recursiveFileLookup", "true")
    if strict:
        reader = reader.option("mode", "FAILFAST")
    else:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BROKEN)

    def load() -> DataFrame:
        with shared_lookups(spark):
            lines = reader.json(place if isinstance(place, str) else [exact_path(root, key) for key in place])
        if strict:
            lines = lines.withColumn(_BROKEN, F.lit(None).cast("string"))
        return lines.withColumnRenamed("key", "event_key").withColumn("key", metadata_key(root))

    named = [T.StructField("event_key" if field.name == "key" else field.name, field.dataType) for field in schema]
    shape = T.StructType([*named, T.StructField("key", T.StringType())])
    if not isinstance(place, str):
        return load() if place else no_rows(spark, shape)
    return load_or_empty(spark, root, load, shape)


def _mark_of(lines: DataFrame) -> Column:
    """Null for a good line.

    The reader refuses a query on the broken-line column alone, so no characters of the id
    are put after it, whatever else the query reads.
    """
    return F.concat(F.col(_BROKEN), F.left(F.coalesce("id", F.lit("")), F.lit(0)))


def read_events(
    spark: SparkSession,
    root: str,
    project_id: str | None = None,
    *,
    is_org_admin: bool = False,
    strict: bool = False,
    extra: T.StructType | None = None,
    check_keys: bool = True,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Events of the batch files: ``id, type, body, key``, and the ``extra`` fields if asked, ``key`` among them as ``event_key``.

    One declared schema serves all files, so a field some files lack is null there. Lines that
    are not JSON are left out (``broken_lines`` counts them); with ``strict`` they are an error. Files whose key is
    not one of a batch, such as media, are not opened; ``check_keys=False`` leaves that to the caller. With ``keys``, a
    bounded number of them, just these files are read and no folder is listed; one that is not there is an error.
    """
    fields = T.StructType([*EVENT_LINE, *(extra or [])])
    place = tenant_folder(root, project_id, is_org_admin) if keys is None else list(dict.fromkeys(keys))
    lines = _read_lines(spark, root, place, fields, strict)
    events = lines.where(_mark_of(lines).isNull()).drop(_BROKEN)
    return events.where(_usable()) if check_keys else events


def read_export_events(
    spark: SparkSession,
    root: str,
    project_id: str | None = None,
    *,
    is_org_admin: bool = False,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Events for exports: typed ``body``, plus top-level ``input`` and ``output``; always strict.

    ``keys`` works as for ``read_events``.
    """
    place = tenant_folder(root, project_id, is_org_admin) if keys is None else list(dict.fromkeys(keys))
    return _read_lines(spark, root, place, EXPORT_LINE, strict=True).drop(_BROKEN).where(_usable())


def read_records(
    spark: SparkSession,
    root: str,
    project_id: str | None = None,
    *,
    is_org_admin: bool = False,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Events with every field they hold: ``record``, the whole line as VARIANT, and ``id, type, key``.

    ``keys`` works as for ``read_events``. ``typed_records`` makes columns of the fields.
    """
    place = tenant_folder(root, project_id, is_org_admin) if keys is None else [exact_path(root, key) for key in dict.fromkeys(keys)]

    def load() -> DataFrame:
        reader = spark.read.option("recursiveFileLookup", "true").option("singleVariantColumn", "record")
        with shared_lookups(spark):
            return reader.json(place).select("record", metadata_key(root).alias("key"))

    shape = "record variant, key string"
    records = load_or_empty(spark, root, load, shape) if isinstance(place, str) else load() if place else no_rows(spark, shape)
    records = records.where(F.col("record").isNotNull() & _usable())
    return records.select(at(F.col("record"), "$.id", "string").alias("id"),
                          at(F.col("record"), "$.type", "string").alias("type"), "record", "key")


def broken_lines(
    spark: SparkSession, root: str, project_id: str | None = None, *, is_org_admin: bool = False
) -> DataFrame:
    """How many lines of each batch file are not JSON: ``key, broken``; files without any are left out."""
    folder = tenant_folder(root, project_id, is_org_admin)
    lines = _read_lines(spark, root, folder, T.StructType([EVENT_LINE["id"]]), strict=False)
    broken = lines.where(_usable() & _mark_of(lines).isNotNull())
    return broken.groupBy("key").agg(F.count(F.lit(1)).alias("broken"))
