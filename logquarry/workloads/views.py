"""Shapes of log data derived from the given tables.

Everything is computed row by row or in groups whose size has a fixed bound, so the work
spreads evenly however skewed users or conversations are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sinks.exports import TIME_FORMATS
from ..sinks.tables import write_event_table, write_traces
from ..sources.compaction import compact_files
from ..sources.inventory import read_inventory, update_inventory
from ..sources.media import read_media_table, update_media_table
from ..sources.skip_index import update_skip_index
from . import staging

# Batch files and blobs belong to this many tenants, each holding the events of one tenant out
# of this many consecutive event ids: a file has a bounded size and is not tiny.
MEMBERS = 200
FILE_SPAN = 1_000_000
# Documents in a batch file of long texts.
FILE_DOCUMENTS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, *parts: Column | str) -> Column:
    columns = (F.col(part) if isinstance(part, str) else part for part in parts)
    return F.concat(F.lit(prefix), *(column.cast("string") for column in columns))


def _session() -> Column:
    """A user group's day."""
    return F.concat(_text("d", F.dayofmonth("ts")), F.lit("-"), (F.col("user_id") % 5).cast("string"))


def _short_hash(text: Column) -> Column:
    return F.left(F.md5(text), F.lit(8))


def _project(user: Column) -> Column:
    return F.concat(F.lit("org"), (user % 4).cast("string"), F.lit("/user"), user.cast("string"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide event table; some bodies are broken and some are null."""
    number = F.col("event_id")
    body = F.when(number % 17 == 0, F.lit("{broken")).when(number % 19 != 0, F.col("props"))
    return table(spark, sf_dir, "events").select(
        _text("ev", number).alias("event_id"),
        "event_type",
        F.col("ts").alias("timestamp"),
        _project(F.col("user_id")).alias("project_id"),
        F.concat(F.lit("model-"), (number % 3).cast("string")).alias("model"),
        _text("on-", "event_type").alias("name"),
        _text("run", F.expr("event_id div 8")).alias("trace_id"),
        _session().alias("session_id"),
        _short_hash(F.col("props")).alias("input_hash"),
        body.alias("body"),
    )


def batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object key per event: extra underscores, missing trace ids and bad stamps included."""
    number = F.col("event_id")
    run = F.expr("event_id div 8")
    trace = F.when(number % 7 == 0, _text("_run_of_", run)).when(number % 11 == 0, F.lit("")).otherwise(_text("_run", run))
    stamp = F.when(number % 13 == 0, F.lit("notatime")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"))
    suffix = F.when(number % 5 == 0, F.lit(".json.jsonl")).otherwise(F.lit(".jsonl"))
    key = F.concat(
        _project(F.col("user_id")), F.lit("/"), _session(), trace, _text("_on-", "event_type"), F.lit("_"),
        _short_hash(F.col("props")), F.lit("_"), stamp, _text("_n", number), suffix,
    )
    return table(spark, sf_dir, "events").select("event_id", key.alias("key"))


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace records with JSON text in the free-form columns."""
    number = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        _text("ev", number).alias("id"),
        F.when(number % 23 != 0, _text("on-", "event_type")).alias("name"),
        F.col("ts").alias("timestamp"),
        _session().alias("sessionId"),
        F.col("props").alias("input"),
        F.lit(None).cast("string").alias("output"),
        F.concat(F.lit('{"k":"'), "event_type", F.lit('"}')).alias("metadata"),
        F.array("event_type").alias("tags"),
        F.col("value").alias("latency"),
        F.round(F.col("value") / 100, 4).alias("totalCost"),
        F.lit(None).cast("string").alias("usage"),
        _project(F.col("user_id")).alias("project_id"),
    )


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per conversation, with all its turns: ``conv_id, input, output``. The last turn is the answer."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    number = F.col("conv_id") + F.col("turn")
    spoken = F.when(number % 5 == 0, F.lit("")).otherwise(F.col("said.text"))
    parts = F.concat(F.lit('[{"type":"text","text":'), _quoted(spoken), F.lit('},{"type":"note","content":"!"}]'))
    content = F.when((F.col("conv_id") % 3 == 1) & (spoken != ""), parts).otherwise(_quoted(spoken))
    message = F.concat(F.lit('{"role":'), _quoted(F.col("said.role")), F.lit(',"content":'), content, F.lit("}"))
    events = (
        turns.select("conv_id", F.struct("turn", message.alias("message")).alias("part"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("part")).alias("parts"))
    )
    messages = F.col("parts.message")
    asked = F.concat(F.lit("["), F.array_join(F.slice(messages, 1, F.size("parts") - 1), ","), F.lit("]"))
    answer = F.element_at(messages, -1)
    even = F.col("conv_id") % 2 == 0
    return events.select(
        "conv_id",
        F.when(even, F.concat(F.lit('{"messages":'), asked, F.lit("}"))).otherwise(asked).alias("input"),
        F.coalesce(
            F.when(even, F.concat(F.lit('{"choices":[{"message":'), answer, F.lit("}]}"))).otherwise(answer),
            F.lit("null"),
        ).alias("output"),
    )


def chat_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"input":'), "input", F.lit(',"output":'), "output", F.lit("}"))
    return chat_events(spark, sf_dir).select("conv_id", body.alias("body"))


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per document; the text sits in one of four input shapes."""
    number = F.col("doc_id")
    text = _quoted(F.col("text"))
    shapes = (
        ("", ""),
        ('{"messages":[{"role":"system","content":"be brief"},{"role":"user","content":', "}]}"),
        ('[{"role":"user","content":[{"type":"text","text":', '},{"content":"end"},{"z":1,"a":2}]}]'),
        ('{"prompt":', ',"b":[1,2]}'),
    )
    given = F.lit(None).cast("string")
    for shape, (before, after) in enumerate(shapes):
        given = F.when(number % 4 == shape, F.concat(F.lit(before), text, F.lit(after))).otherwise(given)
    source = _quoted(F.col("source"))
    answer = (
        F.when(number % 3 == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), source, F.lit("}}]}")))
        .when(number % 3 == 1, F.concat(F.lit('{"content":'), source, F.lit("}")))
        .otherwise(F.lit("null"))
    )
    body = F.concat(
        F.lit('{"model":'), _quoted(F.col("lang")), F.lit(',"input":'), given, F.lit(',"output":'), answer, F.lit("}")
    )
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), number.cast("string")).alias("id"), F.col("lang").alias("type"), body.alias("body")
    )


def _member_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumns(
        {"member": F.col("user_id") % MEMBERS, "span": F.expr(f"event_id div {FILE_SPAN}")}
    )


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of batch files: drifting fields, broken lines and unreadable file names included."""
    number, member = F.col("event_id"), F.col("member")
    trace = (
        F.when(member % 7 == 0, _text("_run_of_", member)).when(member % 11 == 0, F.lit("")).otherwise(_text("_run", member))
    )
    stamp = F.when(member % 13 == 0, F.lit("notatime")).otherwise(F.date_format("first_ts", "yyyyMMdd'T'HHmmss'Z'"))
    key = F.concat(
        _project(member), _text("/s", member % 40), trace, _text("_kind", member % 3), F.lit("_"),
        _short_hash(member.cast("string")), F.lit("_"), stamp, F.format_string("_u%d.jsonl", "span"),
    )
    line = F.concat(
        F.format_string('{"id":"ev%d","type":"', number), "event_type", F.lit('"'),
        F.when(number % 19 == 0, F.lit("")).otherwise(F.concat(F.lit(',"body":'), "props")),
        F.when(number % 23 == 0, F.lit(',"model":"m"')).otherwise(F.lit("")),
        F.format_string(',"trace_id":"own%d","timestamp":"%d"', number % 10, number % 60),
        F.lit("}"),
        F.when(number % 97 == 0, F.lit("\nBROKEN{")).otherwise(F.lit("")),
    )
    members = _member_events(spark, sf_dir)
    # One small row per file: the time of its first event.
    started = members.groupBy("member", "span").agg(F.min("ts").alias("first_ts"))
    events = members.join(started, ["member", "span"])
    return events.select(key.alias("key"), number.alias("position"), line.alias("text"))


def _media_ids() -> dict[str, Column]:
    return {"project_id": _project(F.col("member")), "media_id": F.format_string("m%d-%d", "member", "span")}


def _media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sidecar and a blob per tenant and span of events."""
    stored = (
        _member_events(spark, sf_dir)
        .groupBy("member", "span")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
        .withColumns(_media_ids())
    )
    place = F.concat("project_id", F.lit("/media/"), "media_id")
    uploaded = F.when(F.col("member") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',\n  "uploadedAt": "'), F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('+00:00"'))
    )
    sidecar = F.concat(
        F.format_string('{\n  "contentType": "image/png",\n  "contentLength": %d', F.col("n")), uploaded, F.lit("\n}")
    )
    files = F.array(
        F.struct(F.concat(place, F.lit(".meta.json")).alias("key"), sidecar.alias("text")),
        # A blob that could pass for an event.
        F.struct(F.concat(place, F.lit(".bin")).alias("key"), F.lit('{"id":"blob","type":"t","body":"b"}').alias("text")),
    )
    return stored.select(F.explode(files).alias("file")).select(
        "file.key", F.lit(0).cast("bigint").alias("position"), "file.text"
    )


def media_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media with a purchase among its events, and as many ids that do not exist."""
    bought = _member_events(spark, sf_dir).where(F.col("event_type") == "purchase").select("member", "span").distinct()
    wanted = F.explode(F.array("media_id", F.lit("missing"))).alias("media_id")
    return bought.withColumns(_media_ids()).select("project_id", wanted)


def _chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files of chat events; every other event carries input and output without a body."""
    number, member = F.col("conv_id"), F.col("conv_id") % 20
    key = F.format_string(
        "org%d/user%d/s%d_run%d_chat_c%d_20240101T000000Z_u%d.jsonl",
        number % 4, member, member, member, member, F.expr("conv_id div 10000"),
    )
    content = F.concat(F.lit('"input":'), "input", F.lit(',"output":'), "output")
    line = F.concat(
        F.format_string('{"id":"%d",', number),
        F.when(number % 2 == 0, F.concat(F.lit('"body":{'), content, F.lit("}"))).otherwise(content),
        F.lit("}"),
    )
    return chat_events(spark, sf_dir).select(key.alias("key"), number.alias("position"), line.alias("text"))


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch files of events with long bodies, one file a minute."""
    number, group = F.expr("cast(substring(id, 5) as bigint)"), F.col("group")
    stamp = F.date_format(F.timestamp_add("MINUTE", group, F.lit("2024-01-01").cast("timestamp_ntz")), "yyyyMMdd'T'HHmmss'Z'")
    key = F.concat(
        F.format_string("org%d/user%d/s%d_run%d_doc_d%d_", group % 4, group % 52, group % 7, group, group % 16), stamp,
        F.format_string("_u%d.jsonl", group),
    )
    line = F.concat(F.lit('{"id":"'), "id", F.lit('","type":"'), "type", F.lit('","body":'), "body", F.lit("}"))
    events = document_events(spark, sf_dir).withColumn("position", number)
    events = events.withColumn("group", F.expr(f"position div {FILE_DOCUMENTS}"))
    return events.select(key.alias("key"), "position", line.alias("text"))


_roots: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, build) -> str:
    """The root of a set of derived files, written on first use in a Spark application."""
    place = (spark.sparkContext.applicationId, sf_dir, label)
    if place not in _roots:
        root = staging.scratch(spark, label)
        build(root)
        _roots[place] = root
    return _roots[place]


def log_root(spark: SparkSession, sf_dir: str) -> str:
    """A root with the batch and media files of all tenants."""

    def build(root: str) -> None:
        staging.write_named_files(_event_files(spark, sf_dir), root)
        staging.write_named_files(_media_files(spark, sf_dir), root)

    return _once(spark, sf_dir, "logs", build)


def chat_root(spark: SparkSession, sf_dir: str) -> str:
    """A root with the batch files of chat events."""
    return _once(spark, sf_dir, "chats", lambda root: staging.write_named_files(_chat_files(spark, sf_dir), root))


def trace_root(spark: SparkSession, sf_dir: str) -> str:
    """Trace records landed as JSON lines."""

    def build(root: str) -> None:
        records = trace_records(spark, sf_dir)
        free_form = {name: F.try_parse_json(name) for name in ("input", "output", "metadata", "usage")}
        records.withColumns(free_form).write.options(**TIME_FORMATS).json(root)

    return _once(spark, sf_dir, "traces", build)


def event_table_root(spark: SparkSession, sf_dir: str) -> str:
    """The wide event table as Parquet, laid out by org and day."""

    def build(root: str) -> None:
        layout = {"org": F.substring_index("project_id", "/", 1), "day": F.to_date("timestamp")}
        # One task writes a partition, so there are no small files.
        laid_out = event_log(spark, sf_dir).withColumns(layout).repartition(*layout)
        laid_out.write.partitionBy(*layout).parquet(root)

    return _once(spark, sf_dir, "events", build)


def document_root(spark: SparkSession, sf_dir: str) -> str:
    """A root with the batch files of documents."""
    return _once(spark, sf_dir, "documents", lambda root: staging.write_named_files(_document_files(spark, sf_dir), root))


def log_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored inventory of the log files."""

    def build(path: str) -> None:
        update_inventory(spark, log_root(spark, sf_dir), path, staging.scratch(spark, "stream"))

    return read_inventory(spark, _once(spark, sf_dir, "log-inventory", build))


def document_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored inventory of the files of documents."""

    def build(path: str) -> None:
        update_inventory(spark, document_root(spark, sf_dir), path, staging.scratch(spark, "stream"))

    return read_inventory(spark, _once(spark, sf_dir, "document-inventory", build))


def document_skip_index(spark: SparkSession, sf_dir: str) -> str:
    """Where the skip index of the files of documents is."""

    def build(path: str) -> None:
        update_skip_index(spark, document_root(spark, sf_dir), document_inventory(spark, sf_dir), path)

    return _once(spark, sf_dir, "document-index", build)


def media_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored sidecars."""

    def build(path: str) -> None:
        update_media_table(spark, log_root(spark, sf_dir), path, staging.scratch(spark, "stream"))

    return read_media_table(spark, _once(spark, sf_dir, "media", build))


def compacted_logs(spark: SparkSession, sf_dir: str) -> str:
    """Where the compacted log files are."""

    def build(path: str) -> None:
        model = T.StructType([T.StructField("model", T.StringType())])
        compact_files(spark, log_root(spark, sf_dir), path, staging.scratch(spark, "stream"), extra=model)

    return _once(spark, sf_dir, "compacted", build)


def lookup_event_table(spark: SparkSession, sf_dir: str) -> str:
    """Where the event table with filters for single ids is."""
    return _once(spark, sf_dir, "lookup-events", lambda path: write_event_table(event_log(spark, sf_dir), path))


def lookup_trace_table(spark: SparkSession, sf_dir: str) -> str:
    """Where the traces with filters for single ids are."""
    return _once(spark, sf_dir, "lookup-traces", lambda path: write_traces(trace_records(spark, sf_dir), path))
