"""Limits and newest-first results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The defaults of the entry points.
SEARCH_LIMIT = 50
FILE_SEARCH_LIMIT = 100
RECENT_LIMIT = 100


def check_limit(limit: int | None, most: int | None = None) -> int | None:
    """The limit as given; None means all rows. A negative limit, or one above ``most``, is an error."""
    if limit is not None and limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    if most is not None and (limit is None or limit > most):
        raise ValueError(f"limit must be at most {most}: {limit}")
    return limit


def newest(
    df: DataFrame, limit: int | None, *, column: str = "timestamp", ties: tuple[str, ...] = ("event_id",)
) -> DataFrame:
    """The newest rows. Every task keeps its own best ``limit`` rows, so no full sort is done.

    Without a limit all rows come back, in no order.
    """
    if check_limit(limit) is None:
        return df
    return df.orderBy(F.col(column).desc(), *ties).limit(limit)


def any_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """Some rows in no order; collecting them stops as soon as enough are found. None means all rows."""
    return df if check_limit(limit) is None else df.limit(limit)
