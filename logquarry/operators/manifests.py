"""File manifests: keys with locations and an expiry time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rewrite_base
from ..functions.times import expiry
from .filters import owned


def location(
    key: Column, base_uri: str, internal_uri: str | None = None, public_uri: str | None = None
) -> Column:
    """Where a key can be fetched; the internal address is replaced by the public one."""
    return rewrite_base(F.concat(F.lit(base_uri.rstrip("/") + "/"), key), internal_uri, public_uri)


def manifest(
    df: DataFrame,
    base_uri: str | None = None,
    *,
    internal_uri: str | None = None,
    public_uri: str | None = None,
    ttl_seconds: int | None = None,
    now: datetime | None = None,
    key_col: str = "key",
) -> DataFrame:
    """Add ``url`` when a base is given and ``url_expiry`` when a time to live is given."""
    if base_uri is not None:
        df = df.withColumn("url", location(F.col(key_col), base_uri, internal_uri, public_uri))
    if ttl_seconds is not None:
        df = df.withColumn("url_expiry", expiry(ttl_seconds, now))
    return df


def locate(
    keys: DataFrame,
    project_id: str,
    base_uri: str,
    *,
    is_org_admin: bool = False,
    internal_uri: str | None = None,
    public_uri: str | None = None,
) -> DataFrame:
    """``key, url`` of the requested keys the tenant may see."""
    seen = owned(keys, project_id, is_org_admin).select("key")
    return manifest(seen, base_uri, internal_uri=internal_uri, public_uri=public_uri)
