"""Tenant, time, id and text filters. An argument left unset adds no predicate."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, org_of
from ..functions.times import as_utc, bound_literal, comparable
from ..sources.files import tenant_prefix


def tenant(
    df: DataFrame, project_id: str, is_org_admin: bool = False, *, org_col: str | None = None
) -> DataFrame:
    """Rows of one tenant, or of the whole org for an admin whose key has the form ``org/user``.

    ``org_col`` names a partition column that holds the org; it makes Spark skip the
    partitions of other orgs.
    """
    if org_col:
        df = df.where(F.col(org_col) == org_of(project_id))
    if is_org_admin and "/" in project_id:
        return df.where(F.startswith(F.col("project_id"), F.lit(org_of(project_id) + "/")))
    return df.where(F.col("project_id") == project_id)


def tenant_files(df: DataFrame, project_id: str, is_org_admin: bool = False, *, key_col: str = "key") -> DataFrame:
    """Files below the tenant's folder, nested folders included."""
    return df.where(F.startswith(F.col(key_col), F.lit(tenant_prefix(project_id, is_org_admin))))


# A requested key outside the tenant's folder is dropped without an error.
owned = tenant_files


def time_range(
    df: DataFrame,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    *,
    column: str = "timestamp",
    date_col: str | None = None,
) -> DataFrame:
    """Rows between the bounds, both inclusive and both optional.

    ``date_col`` names a partition column with the UTC date of ``column``.
    """
    if start:
        df = df.where(comparable(df, column) >= bound_literal(df, column, start))
        if date_col:
            df = df.where(F.col(date_col) >= F.lit(as_utc(start).date()))
    if end:
        df = df.where(comparable(df, column) <= bound_literal(df, column, end))
        if date_col:
            df = df.where(F.col(date_col) <= F.lit(as_utc(end).date()))
    return df


def ids(
    df: DataFrame,
    *,
    session_id: str | None = None,
    trace_id: str | None = None,
    trace_type: str | None = None,
    input_hash: str | None = None,
    type_col: str = "trace_type",
) -> DataFrame:
    """Equality on the ids that are given."""
    wanted = {"session_id": session_id, "trace_id": trace_id, type_col: trace_type, "input_hash": input_hash}
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def text(
    df: DataFrame, query: str | None, columns: Sequence[str] = ("body",), *, case: bool = False, wildcard: bool = True
) -> DataFrame:
    """Rows where any of the columns holds the query; ``*`` or nothing keeps all rows."""
    if not query or query == "*":
        return df
    found = F.lit(False)
    for column in columns:
        found = found | matches(F.col(column), query, case=case, wildcard=wildcard)
    return df.where(found)
