"""Listing, locations and media of named ``files`` sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..operators import manifests
from ..sources.registry import Source
from .media import media
from .search import list_files


def _addresses(source: Source) -> dict[str, str]:
    if source.kind != "files":
        raise ValueError(f"source {source.name!r} is of kind {source.kind!r}, not 'files'")
    return {
        "base_uri": source.base_uri or source.root,
        "internal_uri": source.internal_uri,
        "public_uri": source.public_uri,
    }


def list_source_files(
    spark: SparkSession, source: Source, project_id: str, *, with_uri: bool = False, **filters
) -> DataFrame:
    """Batch files of a source. With locations, both time bounds are required."""
    addresses = _addresses(source)
    if with_uri and not (filters.get("start") and filters.get("end")):
        raise ValueError("a list with locations needs both start and end")
    files = list_files(spark, source.root, project_id, **filters)
    return manifests.manifest(files, **addresses) if with_uri else files


def locate_source_files(source: Source, keys: DataFrame, project_id: str, *, is_org_admin: bool = False) -> DataFrame:
    """Locations of the requested keys that the tenant may see."""
    return manifests.locate(keys, project_id, is_org_admin=is_org_admin, **_addresses(source))


def source_media(
    spark: SparkSession, source: Source, project_id: str, media_id: str, *, now: datetime | None = None
) -> DataFrame:
    """Metadata and location of one blob; no row when there is no such id."""
    addresses = _addresses(source)
    return media(spark, source.root, project_id, media_id, ttl_seconds=source.ttl_seconds, now=now, **addresses)
