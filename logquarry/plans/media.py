"""Media lookup: metadata and location of stored blobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SAFE_KEY
from ..operators.manifests import manifest
from ..sources.media import MEDIA_COLUMNS, read_media_of, read_one_media_meta


def media(
    spark: SparkSession,
    root: str,
    project_id: str,
    media_id: str,
    base_uri: str,
    *,
    ttl_seconds: int = 3600,
    internal_uri: str | None = None,
    public_uri: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """One row for the blob, or none when there is no such id."""
    found = read_one_media_meta(spark, root, project_id, media_id)
    return manifest(
        found, base_uri, internal_uri=internal_uri, public_uri=public_uri,
        ttl_seconds=ttl_seconds, now=now, key_col="blob_key",
    )


def media_for(
    spark: SparkSession,
    root: str,
    requests: DataFrame,
    base_uri: str,
    *,
    media: DataFrame | None = None,
    ttl_seconds: int = 3600,
    internal_uri: str | None = None,
    public_uri: str | None = None,
    now: datetime | None = None,
) -> DataFrame:
    """The blobs of many ``project_id, media_id`` requests at once; unknown ones and unsafe names give no row.

    ``media`` is a table of sidecars (``read_media_table``): requests are joined with it, nothing is listed and no name passes the driver.
    Without it the media folders of the requested tenants are listed when the plan is made, and their names pass the
    driver, one per tenant.
    """
    wanted = requests.where(F.rlike("project_id", F.lit(f"^{SAFE_KEY}$")) & ~F.contains("project_id", F.lit("..")))
    wanted = wanted.where(~F.startswith("project_id", F.lit("/"))).select("project_id", "media_id")
    if media is None:
        tenants = [row[0] for row in wanted.select("project_id").distinct().collect()]
        media = read_media_of(spark, root, tenants)
    else:
        media = media.select(*MEDIA_COLUMNS)
    found = media.join(wanted, ["project_id", "media_id"], "left_semi").select(*MEDIA_COLUMNS)
    return manifest(
        found, base_uri, internal_uri=internal_uri, public_uri=public_uri,
        ttl_seconds=ttl_seconds, now=now, key_col="blob_key",
    )
