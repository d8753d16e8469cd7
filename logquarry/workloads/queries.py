"""Registered queries. Each takes ``(spark, sf_dir)`` and works on whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonvals import body_or_empty, content_text
from ..functions.keys import with_key_meta
from ..functions.text import sanitize_key
from ..functions.times import iso_utc, preset, trunc_ms
from ..operators.filters import ids, owned, tenant, text, time_range
from ..operators.manifests import locate, manifest
from ..operators.messages import to_messages
from ..operators.projections import file_rows, preview, project_events, trace_rows
from ..operators.records import search_records, typed_records
from ..operators.selection import result_count, scan_stats, select_events, select_files
from ..plans import search as plans
from ..plans.media import media_for
from ..plans.named import list_source_files, locate_source_files, source_media
from ..sinks import exports
from ..sources.compaction import broken_compacted, read_compacted
from ..sources.files import broken_lines, list_batches, read_events, read_export_events, read_records
from ..sources.inventory import read_files
from ..sources.media import read_media_meta
from ..sources.registry import Source, Sources
from ..sources.skip_index import read_skip_index
from ..sources.tables import scan_event_table
from ..sources.traces import scan_traces
from . import staging, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ADMIN = {"project_id": "org1/user5", "is_org_admin": True}
NOW = datetime(2024, 1, 20, tzinfo=timezone.utc)
INTERNAL = "http://store.internal:9000"
PUBLIC = "https://files.example.org"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


# --- event table ---------------------------------------------------------------------------


@query
def search_table_org_ilike(spark, sf_dir):
    return plans.search_table(
        views.event_log(spark, sf_dir), '"K": 7', **ADMIN, start="2024-01-05", end="2024-01-20T12:00:00+05:00", limit=500
    )


@query
def search_table_user_like(spark, sf_dir):
    return plans.search_table(views.event_log(spark, sf_dir), '"k"', "org1/user5", case=True)


@query
def search_table_wildcard(spark, sf_dir):
    return plans.search_table(views.event_log(spark, sf_dir), "K_: %5", **ADMIN, limit=500)


@query
def text_backslash(spark, sf_dir):
    return text(views.document_events(spark, sf_dir), "AN.\\n_h", ["body"]).select("id", "type")


@query
def search_table_ids(spark, sf_dir):
    return plans.search_table(
        views.event_log(spark, sf_dir), "*", **ADMIN, session_id="d9-0", trace_type="on-view", limit=500
    )


@query
def search_table_trace(spark, sf_dir):
    return plans.search_table(views.event_log(spark, sf_dir), "*", **ADMIN, trace_id="run11", limit=500)


@query
def events_by_hash(spark, sf_dir):
    found = ids(views.event_log(spark, sf_dir), input_hash=md5(b'{"k": 7}').hexdigest()[:8])
    return found.select("event_id", "project_id", "input_hash")


@query
def recent(spark, sf_dir):
    return plans.recent(views.event_log(spark, sf_dir), **ADMIN)


@query
def preset_window(spark, sf_dir):
    start, end = preset("7d", NOW)
    return plans.search_table(views.event_log(spark, sf_dir), "*", **ADMIN, start=start, end=end, limit=500)


@query
def tenant_events(spark, sf_dir):
    """All rows of an org in the nine columns, no limit."""
    return project_events(tenant(views.event_log(spark, sf_dir), "org2/user6", True))


@query
def time_range_events(spark, sf_dir):
    rows = time_range(views.event_log(spark, sf_dir), "2024-01-10T06:00:00", "2024-01-12")
    return ids(rows, trace_type="on-signup", type_col="name").select("event_id", "timestamp", "input_hash")


@query
def body_fallback(spark, sf_dir):
    return views.event_log(spark, sf_dir).select("event_id", body_or_empty(F.col("body")).alias("body"))


@query
def text_literal(spark, sf_dir):
    rows = text(views.document_events(spark, sf_dir), "OU%%%", ["body", "type"], wildcard=False)
    return rows.select("id", "type")


@query
def text_any_column(spark, sf_dir):
    return text(views.document_events(spark, sf_dir), "thand%ble", ["body", "id", "type"]).select("id", "type")


@query
def count_results(spark, sf_dir):
    return result_count(text(views.document_events(spark, sf_dir), "hation", ["body"], case=True))


@query
def search_partitioned_table(spark, sf_dir):
    """On a table laid out by org and day: other orgs and days are not read."""
    log = scan_event_table(spark, path=views.event_table_root(spark, sf_dir))
    return plans.search_table(
        log, '"k": 1', **ADMIN, start="2024-01-11T18:00:00", end="2024-01-14", limit=500, org_col="org", date_col="day"
    )


@query
def search_source_table(spark, sf_dir):
    views.event_log(spark, sf_dir).createOrReplaceTempView("wide_event_log")
    source = Source("exact", "table", case_sensitive=True, options={"table": "wide_event_log"})
    return plans.search(spark, source, '{"k": 2%', "org1/user5", is_org_admin=True, limit=500)


@query
def millisecond_times(spark, sf_dir):
    instant = F.col("timestamp").cast("timestamp")
    return views.event_log(spark, sf_dir).select(
        "event_id", iso_utc(instant).alias("timestamp"), iso_utc(trunc_ms(instant)).alias("milliseconds")
    )


@query
def search_table_all_matches(spark, sf_dir):
    return plans.search_table(views.event_log(spark, sf_dir), '"k"', **ADMIN, limit=None)


@query
def search_catalog_table(spark, sf_dir):
    """A table of the session's catalog, by its three-part name."""
    root = views.event_table_root(spark, sf_dir)
    name = f"events_{md5(root.encode()).hexdigest()[:12]}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS spark_catalog.default.{name} USING parquet LOCATION '{root}'")
    spark.catalog.recoverPartitions(f"spark_catalog.default.{name}")
    options = {"table": name, "schema": "default", "catalog": "spark_catalog"}
    source = Source("days", "table", org_col="org", date_col="day", options=options)
    return plans.search(
        spark, Sources([source]).resolve("days", "table"), '"k": 2', **ADMIN, start="2024-01-11", end="2024-01-12", limit=100
    )


@query
def search_table_trace_lookup(spark, sf_dir):
    """One trace in a table whose row groups have filters for ids."""
    log = scan_event_table(spark, path=views.lookup_event_table(spark, sf_dir))
    return plans.search_table(log, "*", **ADMIN, trace_id="run9", limit=500, org_col="org", date_col="day")


# --- keys and files ------------------------------------------------------------------------


@query
def parse_keys(spark, sf_dir):
    parsed = with_key_meta(views.batch_keys(spark, sf_dir))
    return file_rows(parsed)


@query
def owned_keys(spark, sf_dir):
    return owned(views.batch_keys(spark, sf_dir), **ADMIN).select("key")


@query
def sanitize_keys(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", sanitize_key(F.col("text")).alias("tenant_key"))


@query
def list_objects(spark, sf_dir):
    return list_batches(spark, views.log_root(spark, sf_dir)).select("key")


@query
def list_files(spark, sf_dir):
    return plans.list_files(spark, views.log_root(spark, sf_dir), **ADMIN)


@query
def list_files_range(spark, sf_dir):
    return plans.list_files(
        spark, views.log_root(spark, sf_dir), **ADMIN,
        start="2024-01-01T01:00:00", end="2024-01-01T18:00:00Z", trace_type="kind2",
    )


@query
def list_files_ids(spark, sf_dir):
    return plans.list_files(spark, views.log_root(spark, sf_dir), **ADMIN, session_id="s33", trace_id="unknown")


@query
def scan_statistics(spark, sf_dir):
    root = views.log_root(spark, sf_dir)
    return scan_stats(plans.list_files(spark, root, **ADMIN, start="2024-01-01T02:00:00"))


@query
def read_all_events(spark, sf_dir):
    """Every readable line of every batch file."""
    events = read_events(spark, views.log_root(spark, sf_dir), extra=T.StructType([T.StructField("model", T.StringType())]))
    return with_key_meta(events).select("id", "type", "body", "model", "key")


@query
def count_broken_lines(spark, sf_dir):
    return broken_lines(spark, views.log_root(spark, sf_dir))


def _file_results(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", iso_utc(F.col("timestamp")))


@query
def search_files(spark, sf_dir):
    return _file_results(
        plans.search_files(
            spark, views.log_root(spark, sf_dir), "PURCH", **ADMIN,
            start="2024-01-01T02:00:00", end="2024-01-02T12:00:00", limit=500,
        )
    )


@query
def search_files_body(spark, sf_dir):
    return _file_results(plans.search_files(spark, views.log_root(spark, sf_dir), '"k": 7', "org1/user5"))


@query
def search_files_all(spark, sf_dir):
    found = plans.search_files(spark, views.log_root(spark, sf_dir), "*", **ADMIN, session_id="s5", limit=500)
    return _file_results(found)


@query
def search_files_extra_fields(spark, sf_dir):
    model = T.StructType([T.StructField("model", T.StringType())])
    found = plans.search_files(spark, views.log_root(spark, sf_dir), "ev4_", **ADMIN, limit=500, extra=model)
    return _file_results(found)


@query
def search_files_own_fields(spark, sf_dir):
    """Fields of the events that are named like fields of the file names."""
    own = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("timestamp", T.StringType())])
    found = plans.search_files(spark, views.log_root(spark, sf_dir), '"k": 3', **ADMIN, limit=None, extra=own)
    return _file_results(found)


@query
def search_files_any(spark, sf_dir):
    found = plans.search_files(spark, views.log_root(spark, sf_dir), '"k"', **ADMIN, limit=40, newest_first=False)
    return result_count(found)


@query
def list_files_inventory(spark, sf_dir):
    """From a stored inventory of keys; nothing is listed."""
    path = staging.scratch(spark, "inventory")
    list_batches(spark, views.log_root(spark, sf_dir)).write.parquet(path)
    inventory = spark.read.parquet(path)
    return plans.list_files(spark, views.log_root(spark, sf_dir), **ADMIN, inventory=inventory, trace_type="kind0")


@query
def inventory_objects(spark, sf_dir):
    """The inventory that a stream over the root has written, with its layout."""
    inventory = views.log_inventory(spark, sf_dir)
    return inventory.select("key", "org", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query
def search_files_inventory(spark, sf_dir):
    """The newest matches, from files that a stored inventory names."""
    found = plans.search_files(
        spark, views.log_root(spark, sf_dir), '"k": 7', **ADMIN, inventory=views.log_inventory(spark, sf_dir),
        start="2024-01-01T02:00:00", limit=500,
    )
    return _file_results(found)


@query
def search_files_inventory_all(spark, sf_dir):
    """All matches, with a field of the events' own."""
    model = T.StructType([T.StructField("model", T.StringType())])
    found = plans.search_files(
        spark, views.log_root(spark, sf_dir), "PURCH", **ADMIN, inventory=views.log_inventory(spark, sf_dir), limit=None,
        trace_type="kind2", extra=model,
    )
    return _file_results(found)


@query
def search_files_statistics(spark, sf_dir):
    """What a search found, beside how many files its filters chose."""
    found = plans.search_chosen_files(
        spark, views.log_root(spark, sf_dir), "signup", **ADMIN, trace_type="kind1", limit=200
    )
    return found.rows.select("id", "key").withColumn("files_scanned", found.files_scanned.scalar())


@query
def search_files_keys(spark, sf_dir):
    """The files that a search chose."""
    found = plans.search_chosen_files(
        spark, views.log_root(spark, sf_dir), "signup", **ADMIN, trace_type="kind1", limit=10,
        inventory=views.log_inventory(spark, sf_dir),
    )
    return found.keys


def _skipped(spark, sf_dir, q, **how):
    index = read_skip_index(spark, views.document_skip_index(spark, sf_dir))
    found = plans.search_files(
        spark, views.document_root(spark, sf_dir), q, **how, limit=None,
        inventory=views.document_inventory(spark, sf_dir), index=index,
    )
    return _file_results(found)


@query
def search_files_skipping(spark, sf_dir):
    """Files whose trigrams rule the text out stay closed."""
    return _skipped(spark, sf_dir, "erSHsh", project_id="org1/x", is_org_admin=True)


@query
def search_files_skipping_wildcard(spark, sf_dir):
    return _skipped(spark, sf_dir, "hanti%_ha%nd", project_id="org2/x", is_org_admin=True, start="2024-01-01T00:03:00")


@query
def read_chosen_files(spark, sf_dir):
    """The contents of the files that a table of keys names; no other file is looked at."""
    chosen = plans.list_files(
        spark, views.log_root(spark, sf_dir), **ADMIN, inventory=views.log_inventory(spark, sf_dir)
    )
    return read_files(spark, views.log_root(spark, sf_dir), chosen.where(F.col("trace_type") == "kind0"))


@query
def search_compacted_files(spark, sf_dir):
    """The events of batch files that a stream has brought together in one table."""
    model = T.StructType([T.StructField("model", T.StringType())])
    events = read_compacted(spark, views.compacted_logs(spark, sf_dir), extra=model)
    found = plans.search_files(
        spark, views.log_root(spark, sf_dir), "PURCH", **ADMIN, events=events, extra=model,
        start="2024-01-01T02:00:00", end="2024-01-02T12:00:00", limit=500,
    )
    return _file_results(found)


@query
def read_compacted_events(spark, sf_dir):
    """Every readable line of every batch file, from the compacted table."""
    model = T.StructType([T.StructField("model", T.StringType())])
    return read_compacted(spark, views.compacted_logs(spark, sf_dir), extra=model).drop("org", "day")


@query
def count_compacted_broken_lines(spark, sf_dir):
    return broken_compacted(spark, views.compacted_logs(spark, sf_dir))


@query
def search_typed_records(spark, sf_dir):
    """Whole records as search results, with a column for every field of any of them."""
    records = read_records(spark, views.log_root(spark, sf_dir), ADMIN["project_id"], is_org_admin=True)
    found = search_records(records, '"k":7')
    return found.withColumn("file_timestamp", iso_utc(F.col("file_timestamp"))).withColumn("body", F.to_json("body"))


@query
def typed_chat_records(spark, sf_dir):
    """Records with different fields, whose contents are text in some and lists in others: the type of the columns, and the input."""
    records = typed_records(read_records(spark, views.chat_root(spark, sf_dir)))
    types = F.lit(records.drop("file_key").schema.simpleString())
    given = F.coalesce(F.to_json("input"), F.to_json(F.col("body")["input"]))
    return records.select("id", types.alias("types"), F.md5(given).alias("input"))


@query
def list_files_no_tenant(spark, sf_dir):
    return plans.list_files(spark, views.log_root(spark, sf_dir), "nobody/here")


@query
def search_source_files(spark, sf_dir):
    source = Sources([Source("lake", "files", root=views.log_root(spark, sf_dir))]).resolve("lake", "files")
    return _file_results(plans.search(spark, source, "err_r", "org3/user3", is_org_admin=True, limit=500))


@query
def strict_events(spark, sf_dir):
    """Every line must be JSON."""
    return read_events(spark, views.chat_root(spark, sf_dir), strict=True).select("id", "key")


# --- traces --------------------------------------------------------------------------------


def _trace_results(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "timestamp", "session_id", "name", "body", F.array_join("tags", ",").alias("tags"),
                     "latency", "total_cost")


@query
def search_traces(spark, sf_dir):
    found = plans.search_traces(
        views.trace_records(spark, sf_dir), "ON-SIG", start="2024-01-03", end="2024-01-25", limit=500
    )
    return _trace_results(found)


@query
def search_traces_prelimit(spark, sf_dir):
    found = plans.search_traces(
        views.trace_records(spark, sf_dir), '"k": 4', session_id="d3-3", trace_type="on-signup", limit=100, pre_limit=True
    )
    return _trace_results(found)


@query
def search_one_trace(spark, sf_dir):
    found = plans.search_traces(views.trace_records(spark, sf_dir), "*", trace_id="ev42", start="2030-01-01")
    return _trace_results(found)


@query
def search_one_trace_stored(spark, sf_dir):
    """One trace in a table whose row groups have filters for ids."""
    traces = scan_traces(spark, views.lookup_trace_table(spark, sf_dir), fmt="parquet")
    return _trace_results(plans.search_traces(traces, "*", trace_id="ev42"))


@query
def trace_mapping(spark, sf_dir):
    return trace_rows(views.trace_records(spark, sf_dir)).select(
        "id", "type", "trace_id", "session_id", "name", "body", F.element_at("tags", 1).alias("tag"), "latency", "total_cost"
    )


@query
def landed_traces(spark, sf_dir):
    rows = trace_rows(scan_traces(spark, views.trace_root(spark, sf_dir)))
    return rows.select("id", iso_utc(F.col("timestamp")).alias("timestamp"), "name", "body", "total_cost")


@query
def search_source_traces(spark, sf_dir):
    source = Source("traces", "traces", tenant_col="project_id", options={"path": views.trace_root(spark, sf_dir)})
    found = plans.search(spark, source, "signup", **ADMIN, limit=500)
    return found.select("id", iso_utc(F.col("timestamp")).alias("timestamp"), "name", "body")


@query
def search_source_traces_untagged(spark, sf_dir):
    """Traces that belong to nobody in particular."""
    source = Source("traces", "traces", options={"path": views.trace_root(spark, sf_dir)})
    found = plans.search(spark, source, "signup", **ADMIN, limit=500)
    return found.select("id", iso_utc(F.col("timestamp")).alias("timestamp"), "name", "body")


@query
def trace_defaults(spark, sf_dir):
    """Records without sessions, tags and latency."""
    rows = trace_rows(views.trace_records(spark, sf_dir).drop("sessionId", "tags", "latency"))
    return rows.select("id", "session_id", "name", "body", F.size("tags").cast("bigint").alias("n_tags"), "latency")


# --- chat data and previews ----------------------------------------------------------------


def _conversation_rows(df: DataFrame, *keys: str) -> DataFrame:
    texts = F.transform("messages", lambda m: content_text(m["content"]))
    return df.select(
        *keys,
        F.size("messages").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(texts, "|")).alias("contents"),
    )


@query
def chat_dataset(spark, sf_dir):
    return _conversation_rows(to_messages(views.chat_bodies(spark, sf_dir)), "conv_id")


@query
def chat_dataset_files(spark, sf_dir):
    """From batch files, some of whose events have no body."""
    events = read_export_events(spark, views.chat_root(spark, sf_dir), "org1/user5", is_org_admin=True)
    return _conversation_rows(to_messages(plans.filter_files(events, **ADMIN)), "id")


@query
def preview_events(spark, sf_dir):
    shown = preview(views.document_events(spark, sf_dir))
    return shown.select("id", "type", "model", "input_preview", "output_preview")


# --- selections, manifests, media ----------------------------------------------------------


@query
def selected_events(spark, sf_dir):
    log = views.event_log(spark, sf_dir)
    chosen = log.where((F.col("name") == "on-error") & (F.col("model") == "model-1")).select("event_id")
    return select_events(log, chosen, column="event_id").select("event_id", "event_type", "timestamp", "project_id")


@query
def selected_files(spark, sf_dir):
    root = views.log_root(spark, sf_dir)
    chosen = plans.list_files(spark, root, **ADMIN, trace_type="kind1")
    events = read_events(spark, root, ADMIN["project_id"], is_org_admin=True)
    return select_files(events, chosen).select("id", "type", "body", "key")


@query
def manifest_uris(spark, sf_dir):
    return locate(
        views.batch_keys(spark, sf_dir), **ADMIN,
        base_uri=f"{INTERNAL}/logs/{INTERNAL}/", internal_uri=INTERNAL, public_uri=PUBLIC,
    )


@query
def manifest_files(spark, sf_dir):
    files = plans.list_files(spark, views.log_root(spark, sf_dir), **ADMIN, start="2024-01-01", end="2024-01-03")
    return manifest(files, f"{INTERNAL}/logs", internal_uri=INTERNAL, public_uri=PUBLIC, ttl_seconds=3600, now=NOW)


def _media_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("uploaded_at", iso_utc(F.col("uploaded_at"))).drop("key")


@query
def media_metadata(spark, sf_dir):
    return _media_rows(read_media_meta(spark, views.log_root(spark, sf_dir)))


@query
def media_lookup(spark, sf_dir):
    found = media_for(
        spark, views.log_root(spark, sf_dir), views.media_requests(spark, sf_dir), f"{INTERNAL}/logs",
        ttl_seconds=90, internal_uri=INTERNAL, public_uri=PUBLIC, now=NOW,
    )
    return _media_rows(found)


@query
def media_lookup_table(spark, sf_dir):
    """Requests joined with the stored sidecars; a tenant's name that is not safe gives no row."""
    wanted = views.media_requests(spark, sf_dir)
    unsafe = wanted.limit(1).select(F.lit("../org1").alias("project_id"), "media_id")
    found = media_for(
        spark, views.log_root(spark, sf_dir), wanted.unionAll(unsafe), f"{INTERNAL}/logs", media=views.media_table(spark, sf_dir),
        ttl_seconds=90, internal_uri=INTERNAL, public_uri=PUBLIC, now=NOW,
    )
    return _media_rows(found)


@query
def media_of_source(spark, sf_dir):
    source = Source("lake", "files", root=views.log_root(spark, sf_dir), base_uri=f"{INTERNAL}/logs",
                    internal_uri=INTERNAL, public_uri=PUBLIC, ttl_seconds=90)
    return _media_rows(source_media(spark, source, "org1/user5", "m5-0", now=NOW))


@query
def located_source_files(spark, sf_dir):
    """A list with locations, and from it the locations one user may see."""
    source = Source("lake", "files", root=views.log_root(spark, sf_dir), base_uri="s3a://logs")
    listed = list_source_files(spark, source, **ADMIN, with_uri=True, start="2024-01-01", end="2024-01-31")
    return locate_source_files(source, listed.select("key"), "org1/user9")


@query
def selected_events_large(spark, sf_dir):
    log = views.event_log(spark, sf_dir)
    chosen = log.where(F.col("event_type") != "view").select("event_id")
    return select_events(log, chosen, column="event_id").select("event_id", "event_type", "timestamp", "project_id")


@query
def selected_files_large(spark, sf_dir):
    """All files of an org but one kind, as a table of keys."""
    root = views.log_root(spark, sf_dir)
    chosen = plans.list_files(spark, root, **ADMIN).where(F.col("trace_type") != "kind1")
    events = read_events(spark, root, ADMIN["project_id"], is_org_admin=True)
    return select_files(events, chosen)


# --- exports, written and read back --------------------------------------------------------


@query
def export_jsonl_roundtrip(spark, sf_dir):
    log = views.event_log(spark, sf_dir)
    path = staging.scratch(spark, "jsonl")
    exports.export_jsonl(plans.envelope(log), path)
    written = spark.read.schema("id string, type string, timestamp timestamp_ntz, body variant").json(path)
    return written.withColumn("body", F.to_json("body"))


@query
def export_catalog_roundtrip(spark, sf_dir):
    path = staging.scratch(spark, "catalog")
    records = read_records(spark, views.log_root(spark, sf_dir))
    exports.export_catalog(with_key_meta(records), path)
    written = spark.read.schema("id string, type string, body variant, model string").json(path)
    return written.withColumn("body", F.to_json("body"))


@query
def export_index_roundtrip(spark, sf_dir):
    path = staging.scratch(spark, "index")
    exports.export_index(manifest(views.batch_keys(spark, sf_dir), "s3a://logs"), path)
    return spark.read.schema("key string, url string").json(path)


@query
def export_url_index_roundtrip(spark, sf_dir):
    path = staging.scratch(spark, "urls")
    files = plans.list_files(spark, views.log_root(spark, sf_dir), **ADMIN)
    exports.export_index(manifest(files, "s3a://logs"), path, with_key=False)
    return spark.read.schema("url string").json(path)


@query
def export_dataset_roundtrip(spark, sf_dir):
    path = staging.scratch(spark, "dataset")
    exports.export_dataset(views.chat_bodies(spark, sf_dir), path)
    return _conversation_rows(spark.read.schema("messages array<struct<role: string, content: variant>>").json(path))


@query
def export_traces_roundtrip(spark, sf_dir):
    """The written text itself: null fields are there."""
    path = staging.scratch(spark, "traces")
    rows = trace_rows(views.trace_records(spark, sf_dir)).withColumn("output", F.lit(None).cast("string"))
    exports.export_jsonl(rows.select("id", "name", "output", "session_id", "usage"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))
