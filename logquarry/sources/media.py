"""Media sidecars: small JSON objects at ``{tenant}/media/{id}.meta.json``. A broken one is an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import require_clean
from ..functions.times import require_iso
from ..schemas import MEDIA_META, no_rows
from .files import exact_path, exists, load_or_empty, metadata_key, tenant_folder

# Fixed value: where sidecars are.
PLACE = r"^(.*)/media/([^/]+)\.meta\.json$"
_OUTPUT = (
    "key string, project_id string, media_id string, blob_key string, "
    "content_type string, content_length long, uploaded_at timestamp"
)


MEDIA_COLUMNS = tuple(field.split()[0] for field in _OUTPUT.split(", "))
_OPTIONS = {"recursiveFileLookup": "true", "pathGlobFilter": "*.meta.json", "multiLine": "true", "mode": "FAILFAST"}


def _shaped(sidecars: DataFrame, root: str) -> DataFrame:
    return (
        sidecars.withColumn("key", metadata_key(root))
        .where(F.col("key").rlike(PLACE))
        .withColumn("project_id", F.regexp_extract("key", PLACE, 1))
        .withColumn("media_id", F.regexp_extract("key", PLACE, 2))
        .select(
            "key",
            "project_id",
            "media_id",
            F.concat("project_id", F.lit("/media/"), "media_id", F.lit(".bin")).alias("blob_key"),
            F.col("contentType").alias("content_type"),
            F.col("contentLength").alias("content_length"),
            require_iso(F.col("uploadedAt")).alias("uploaded_at"),
        )
    )


def _shape(spark: SparkSession, root: str, *paths: str) -> DataFrame:
    reader = spark.read.schema(MEDIA_META).options(**_OPTIONS)
    return load_or_empty(spark, root, lambda: _shaped(reader.json(list(paths)), root), _OUTPUT)


def update_media_table(
    spark: SparkSession, root: str, path: str, checkpoint: str, project_id: str | None = None, *, files_at_once: int = 10_000
) -> None:
    """Append the sidecars that were not there at the last run to a table, which lookups join instead of listing folders.

    A file stream with its own ``checkpoint`` reads every sidecar once. It lists the root, or one tenant's media folder. The table is laid
    out by ``org``.
    """
    folder = tenant_folder(root, project_id) + ("" if project_id is None else "media")
    reader = spark.readStream.schema(MEDIA_META).options(**_OPTIONS)
    # A late file is old by its own clock; none may be left out.
    sidecars = reader.option("maxFilesPerTrigger", files_at_once).option("maxFileAge", "36500d").json(folder)
    run = (
        _shaped(sidecars, root)
        .withColumn("org", F.substring_index("project_id", "/", 1))
        .writeStream.format("parquet")
        .partitionBy("org")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def read_media_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored sidecars, as ``read_media_meta`` has them, and ``org``."""
    return spark.read.schema(_OUTPUT + ", org string").parquet(path)


def read_media_meta(spark: SparkSession, root: str, project_id: str | None = None) -> DataFrame:
    """All sidecars below the root, or those of one tenant."""
    folder = tenant_folder(root, project_id)
    if project_id is None:
        return _shape(spark, root, folder)
    found = _shape(spark, root, folder + "media")
    return found.where(F.col("project_id") == project_id)


def read_media_of(spark: SparkSession, root: str, tenants: Iterable[str]) -> DataFrame:
    """The sidecars of some tenants; only their media folders are listed."""
    folders = [tenant_folder(root, tenant) + "media" for tenant in dict.fromkeys(tenants)]
    there = [folder for folder in folders if exists(spark, folder)]
    return _shape(spark, root, *there) if there else no_rows(spark, _OUTPUT)


def read_one_media_meta(spark: SparkSession, root: str, project_id: str, media_id: str) -> DataFrame:
    """The sidecar of one id, read by its own path without listing a folder; no rows if missing."""
    if "/" in media_id or not media_id:
        raise ValueError(f"not a media id: {media_id!r}")
    require_clean(project_id)
    return _shape(spark, root, exact_path(root, f"{project_id}/media/{media_id}.meta.json"))
