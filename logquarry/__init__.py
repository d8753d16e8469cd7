"""Browse, search and export logs of model calls with Spark."""

from .functions.jsonvals import body_or_empty, content_text, json_valid
from .functions.keys import key_fields, with_key_meta
from .functions.text import clean_tenant, rewrite_base, sanitize_key
from .functions.times import iso_utc, preset
from .operators.filters import ids, owned, tenant, tenant_files, text, time_range
from .operators.manifests import locate, manifest
from .operators.messages import to_messages
from .operators.projections import envelope, file_rows, preview, project_events, trace_rows
from .operators.ranking import any_rows, newest
from .operators.records import record_schema, search_records, typed_records
from .operators.selection import result_count, scan_stats, select_events, select_files
from .plans.media import media, media_for
from .plans.named import list_source_files, locate_source_files, source_media
from .plans.search import (
    FileSearch,
    chosen_files,
    list_files,
    recent,
    search,
    search_chosen_files,
    search_files,
    search_table,
    search_traces,
)
from .sinks.exports import export_catalog, export_dataset, export_index, export_jsonl
from .sinks.tables import write_event_table, write_traces
from .sources.compaction import broken_compacted, compact_files, read_compacted
from .sources.files import broken_lines, list_batches, read_events, read_export_events, read_records
from .sources.inventory import read_files, read_inventory, scan_slices, update_inventory
from .sources.media import read_media_meta, read_media_of, read_media_table, read_one_media_meta, update_media_table
from .sources.registry import Source, Sources
from .sources.skip_index import read_skip_index, update_skip_index
from .sources.tables import scan_event_table
from .sources.traces import scan_traces

__all__ = [
    "FileSearch",
    "Source",
    "Sources",
    "any_rows",
    "body_or_empty",
    "broken_compacted",
    "broken_lines",
    "chosen_files",
    "clean_tenant",
    "compact_files",
    "content_text",
    "envelope",
    "export_catalog",
    "export_dataset",
    "export_index",
    "export_jsonl",
    "file_rows",
    "ids",
    "iso_utc",
    "json_valid",
    "key_fields",
    "list_batches",
    "list_files",
    "list_source_files",
    "locate",
    "locate_source_files",
    "manifest",
    "media",
    "media_for",
    "newest",
    "owned",
    "preset",
    "preview",
    "project_events",
    "read_compacted",
    "read_events",
    "read_export_events",
    "read_files",
    "read_inventory",
    "read_media_meta",
    "read_media_of",
    "read_media_table",
    "read_one_media_meta",
    "read_records",
    "read_skip_index",
    "recent",
    "record_schema",
    "result_count",
    "rewrite_base",
    "sanitize_key",
    "scan_event_table",
    "scan_slices",
    "scan_stats",
    "scan_traces",
    "search",
    "search_chosen_files",
    "search_files",
    "search_records",
    "search_table",
    "search_traces",
    "select_events",
    "select_files",
    "source_media",
    "tenant",
    "tenant_files",
    "text",
    "time_range",
    "to_messages",
    "trace_rows",
    "typed_records",
    "update_inventory",
    "update_media_table",
    "update_skip_index",
    "with_key_meta",
    "write_event_table",
    "write_traces",
]
