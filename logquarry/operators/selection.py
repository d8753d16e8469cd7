"""Rows picked by id, and counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chosen_rows(df: DataFrame, column: str, chosen: DataFrame | Iterable[str]) -> DataFrame:
    """The rows with a chosen value, in the columns of ``df``.

    Values in a list travel inside the query, where they let the reader skip files and row groups. A DataFrame of
    them is joined, and nothing of it is collected. How many there are plays no part.
    """
    if not isinstance(chosen, DataFrame):
        return df.where(F.col(column).isin(list(chosen)))
    wanted = chosen.select(F.col(column).alias("_chosen"))
    return df.join(wanted, F.col(column) == F.col("_chosen"), "left_semi")


def select_events(df: DataFrame, chosen: DataFrame | Iterable[str] | None, *, column: str = "id") -> DataFrame:
    """The chosen events; with nothing chosen (None, or an empty list or table), all of them."""
    if chosen is None:
        return df
    if isinstance(chosen, DataFrame):
        # Whether anything is chosen is asked at once, by a job that stops at the first row.
        return df if chosen.where(F.col(column).isNotNull()).isEmpty() else chosen_rows(df, column, chosen)
    chosen = list(chosen)
    return chosen_rows(df, column, chosen) if chosen else df


def select_files(df: DataFrame, chosen: DataFrame | Iterable[str], *, column: str = "key") -> DataFrame:
    """Rows of the chosen files; with nothing chosen, none."""
    return chosen_rows(df, column, chosen)


def scan_stats(keys: DataFrame) -> DataFrame:
    """One row with the number of files; the key list itself is the input."""
    return keys.agg(F.count(F.lit(1)).alias("files_scanned"))


def result_count(df: DataFrame) -> DataFrame:
    """One row with the number of results."""
    return df.agg(F.count(F.lit(1)).alias("results"))
