"""Searches over the three shapes of event data, and the dispatch between them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import with_key_meta
from ..operators.filters import ids, tenant, tenant_files, text, time_range
from ..operators.projections import envelope, file_rows, project_events, trace_body, trace_rows
from ..operators.ranking import (
    FILE_SEARCH_LIMIT,
    RECENT_LIMIT,
    SEARCH_LIMIT,
    any_rows,
    check_limit,
    newest,
)
from ..operators.selection import scan_stats
from ..sources.files import list_batches, read_events
from ..sources.inventory import key_slices, pruned
from ..sources.registry import Source
from ..sources.skip_index import not_ruled_out
from ..sources.tables import scan_event_table
from ..sources.traces import scan_traces

Bound = datetime | str | None


def filter_table(
    df: DataFrame,
    project_id: str,
    *,
    is_org_admin: bool = False,
    start: Bound = None,
    end: Bound = None,
    session_id: str | None = None,
    trace_id: str | None = None,
    trace_type: str | None = None,
    input_hash: str | None = None,
    org_col: str | None = None,
    date_col: str | None = None,
) -> DataFrame:
    """Event-table rows of a tenant that pass the optional filters."""
    df = tenant(df, project_id, is_org_admin, org_col=org_col)
    df = time_range(df, start, end, date_col=date_col)
    return ids(
        df, session_id=session_id, trace_id=trace_id, trace_type=trace_type, input_hash=input_hash, type_col="name"
    )


def search_table(
    df: DataFrame,
    q: str | None,
    project_id: str,
    *,
    limit: int | None = SEARCH_LIMIT,
    case: bool = False,
    wildcard: bool = True,
    **filters,
) -> DataFrame:
    """Full-text search on an event table, newest first, as result envelopes.

    The rows are ranked before the bodies are checked, so only returned bodies are parsed. ``limit=None`` returns
    all matches, in no order.
    """
    found = text(filter_table(df, project_id, **filters), q, ["body"], case=case, wildcard=wildcard)
    return envelope(newest(project_events(found), limit))


def recent(df: DataFrame, project_id: str, *, limit: int | None = RECENT_LIMIT, **filters) -> DataFrame:
    """The newest events of a tenant."""
    return search_table(df, "*", project_id, limit=limit, **filters)


def filter_files(
    df: DataFrame,
    project_id: str,
    *,
    is_org_admin: bool = False,
    start: Bound = None,
    end: Bound = None,
    session_id: str | None = None,
    trace_id: str | None = None,
    trace_type: str | None = None,
    input_hash: str | None = None,
) -> DataFrame:
    """Rows whose ``key`` is a readable key of the tenant and passes the optional filters."""
    df = with_key_meta(tenant_files(df, project_id, is_org_admin))
    df = time_range(df, start, end)
    return ids(df, session_id=session_id, trace_id=trace_id, trace_type=trace_type, input_hash=input_hash)


def chosen_files(
    spark: SparkSession,
    root: str,
    project_id: str,
    *,
    is_org_admin: bool = False,
    inventory: DataFrame | None = None,
    **filters,
) -> DataFrame:
    """The batch files of a tenant that pass the filters: what is known of each, and the fields of its name.

    ``inventory`` is a table with a ``key`` column, each key once, such as a stored one (``read_inventory``). It takes the
    place of the listing, which Spark holds on the driver; of one laid out by org and day only the partitions in question are read.
    """
    if inventory is None:
        inventory = list_batches(spark, root, project_id, is_org_admin=is_org_admin)
    objects = pruned(inventory, project_id, filters.get("start"), filters.get("end"))
    objects = objects.select(*(name for name in ("key", "length", "modified") if name in objects.columns))
    return filter_files(objects, project_id, is_org_admin=is_org_admin, **filters)


def list_files(
    spark: SparkSession,
    root: str,
    project_id: str,
    *,
    is_org_admin: bool = False,
    inventory: DataFrame | None = None,
    **filters,
) -> DataFrame:
    """Batch files of a tenant with the metadata their names carry. No file is opened.

    With an ``inventory``, as for ``chosen_files``, nothing is listed either.
    """
    return file_rows(chosen_files(spark, root, project_id, is_org_admin=is_org_admin, inventory=inventory, **filters))


def _shown_names(extra: T.StructType | None) -> dict[str, str]:
    return {f.name: f"event_{f.name}" if f.name in ("timestamp", "key") else f.name for f in extra or []}


def _matching(events: DataFrame, q: str | None, wildcard: bool, shown: dict[str, str]) -> DataFrame:
    """The events that hold the text, with the fields of their own in a struct, where they cannot meet those of the file's name."""
    own = F.struct(*(F.col("event_key" if name == "key" else name).alias(shown[name]) for name in shown)) if shown else F.lit("")
    events = events.select("id", "type", "body", "key", own.alias("_own"))
    return text(events, q, ["body", "id", "type"], wildcard=wildcard)


def _file_results(found: DataFrame, shown: dict[str, str]) -> DataFrame:
    return found.select("id", "type", "timestamp", "body", "key", *(F.col("_own")[name].alias(name) for name in shown.values()))


@dataclass(frozen=True)
class FileSearch:
    """What a search in files found, and which files it chose.

    ``keys`` are the files that the names leave, as ``list_files`` has them, and ``files_scanned`` is one row with their number. ``files_opened``
    is how many of them were read: a skip index rules some out, and a search stops when it has enough.
    """

    rows: DataFrame
    keys: DataFrame
    files_scanned: DataFrame
    files_opened: int


_FILE_TIES = ("key", "id", "body")


def search_chosen_files(
    spark: SparkSession,
    root: str,
    q: str | None,
    project_id: str,
    *,
    limit: int | None = FILE_SEARCH_LIMIT,
    extra: T.StructType | None = None,
    wildcard: bool = True,
    inventory: DataFrame | None = None,
    index: DataFrame | None = None,
    **filters,
) -> FileSearch:
    """Full-text search in batch files that are chosen first, with the choice as a second result.

    The files are taken newest first, in slices that grow, and read by their exact paths. All rows of a slice rank before those of
    the next, so the search ends with the slice that fills the limit: it runs at once, and its rows, no more than
    ``limit``, come back as a table. ``limit=None`` gives a table that is read when it is used. The listing, or the
    ``inventory``, is gone through once for the search; ``files_scanned`` counts it when it is asked for.

    ``index`` is a skip index (``read_skip_index``): files that it rules out are not opened. The inventory then has ``modified`` too.
    """
    check_limit(limit)
    shown = _shown_names(extra)
    chosen = chosen_files(spark, root, project_id, inventory=inventory, **filters)
    left = chosen
    if index is not None:
        index = pruned(index, project_id, filters.get("start"), filters.get("end"))
        left = not_ruled_out(chosen, index, q, wildcard=wildcard)

    def results(keys: Sequence[str]) -> DataFrame:
        events = read_events(spark, root, extra=extra, check_keys=False, keys=keys)
        return _file_results(with_key_meta(_matching(events, q, wildcard, shown)), shown)

    opened, parts = 0, []
    if limit is None:
        for keys in key_slices(left):
            opened += len(keys)
            parts.append(results(keys))
        rows = reduce(DataFrame.unionByName, parts) if parts else results([])
    else:
        missing, schema = limit, results([]).schema
        for keys in key_slices(left) if limit else ():
            opened += len(keys)
            parts.append(newest(results(keys), missing, ties=_FILE_TIES).toArrow())
            missing -= parts[-1].num_rows
            if missing <= 0:
                break
        rows = spark.createDataFrame(pa.concat_tables(parts), schema) if limit > missing else results([])
    return FileSearch(rows, file_rows(chosen), scan_stats(chosen), opened)


def search_files(
    spark: SparkSession,
    root: str,
    q: str | None,
    project_id: str,
    *,
    is_org_admin: bool = False,
    limit: int | None = FILE_SEARCH_LIMIT,
    newest_first: bool = True,
    extra: T.StructType | None = None,
    wildcard: bool = True,
    inventory: DataFrame | None = None,
    index: DataFrame | None = None,
    events: DataFrame | None = None,
    **filters,
) -> DataFrame:
    """Full-text search in body, id and type of the events in the tenant's batch files.

    Files ruled out by their names are never opened. Results come newest file first; with
    ``newest_first=False`` they come in any order and collecting them stops early; ``limit=None`` returns all.
    ``extra`` declares more fields of the events to read. Those named like a column of the result (``timestamp``
    is the file's) come back as ``event_...``.

    With an ``inventory`` no folder is listed, and the search runs at once, as ``search_chosen_files`` says; a skip ``index`` keeps
    more files closed. ``events`` is a table of the files' events that takes their place (``read_compacted``, with the same ``extra``).
    """
    if inventory is not None or index is not None:
        return search_chosen_files(
            spark, root, q, project_id, is_org_admin=is_org_admin, limit=limit, extra=extra, wildcard=wildcard,
            inventory=inventory, index=index, **filters,
        ).rows
    shown = _shown_names(extra)
    if events is None:
        events = read_events(spark, root, project_id, is_org_admin=is_org_admin, extra=extra, check_keys=False)
    else:
        events = pruned(events, project_id, filters.get("start"), filters.get("end"))
    # Text first: the filters on keys choose the files before any row is read, but Spark checks
    # them again on each row, and that way only on rows that hold the text.
    found = _matching(events, q, wildcard, shown)
    found = _file_results(filter_files(found, project_id, is_org_admin=is_org_admin, **filters), shown)
    if not newest_first:
        return any_rows(found, limit)
    return newest(found, limit, ties=_FILE_TIES)


def search_traces(
    df: DataFrame,
    q: str | None,
    *,
    project_id: str | None = None,
    is_org_admin: bool = False,
    start: Bound = None,
    end: Bound = None,
    session_id: str | None = None,
    trace_id: str | None = None,
    trace_type: str | None = None,
    input_hash: str | None = None,
    limit: int | None = SEARCH_LIMIT,
    pre_limit: bool = False,
    tenant_col: str = "project_id",
) -> DataFrame:
    """Search trace records, newest first.

    All traces are searched; with ``pre_limit`` only the newest ``limit`` are, so that fewer may come back. Asking
    for one trace by id ignores time, session and the first limit. A ``project_id`` keeps the traces of a tenant, by
    ``tenant_col``; traces without that column cannot be told apart, and asking then is an error. ``input_hash`` is
    accepted and has no effect: traces carry no hash.
    """
    check_limit(limit)
    if project_id is not None:
        if tenant_col not in df.columns:
            raise ValueError(f"traces have no column {tenant_col!r} to find a tenant by")
        names = df.columns
        df = tenant(df.withColumn("project_id", F.col(tenant_col)), project_id, is_org_admin).select(*names)
    if trace_id:
        df = df.where(F.col("id") == trace_id)
    else:
        df = time_range(df, start, end)
        if session_id:
            df = df.where(F.col("sessionId") == session_id)
        if pre_limit:
            df = newest(df, limit, ties=("id",))
    if trace_type:
        df = df.where(F.col("name") == trace_type)
    if q and q != "*":
        searched = df.withColumn("_searched", F.concat(trace_body(df), F.coalesce("name", F.lit(""))))
        df = text(searched, q, ["_searched"], wildcard=False).drop("_searched")
    # Ranked before they are mapped, so only returned traces are printed as JSON.
    return trace_rows(newest(df, limit, ties=("id",)))


def search(
    spark: SparkSession, source: Source, q: str, project_id: str, *, limit: int | None = SEARCH_LIMIT, **filters
) -> DataFrame:
    """Search one named source, whatever its kind."""
    if not q:
        raise ValueError("the query must not be empty; use '*' to match everything")
    if source.kind == "files":
        return search_files(spark, source.root, q, project_id, limit=limit, **filters)
    if source.kind == "table":
        table = scan_event_table(spark, **source.options)
        layout = {"org_col": source.org_col, "date_col": source.date_col}
        return search_table(table, q, project_id, limit=limit, case=source.case_sensitive, **layout | filters)
    if source.kind == "traces":
        traces = scan_traces(spark, **source.options)
        if source.tenant_col is None:
            filters.pop("is_org_admin", None)
            return search_traces(traces, q, limit=limit, **filters)
        return search_traces(traces, q, project_id=project_id, tenant_col=source.tenant_col, limit=limit, **filters)
    raise ValueError(f"search is not supported for source kind {source.kind!r}")
