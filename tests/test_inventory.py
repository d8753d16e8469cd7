import json
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import logquarry as lq
from logquarry.operators.manifests import manifest
from logquarry.plans.search import filter_files
from logquarry.schemas import no_rows
from logquarry.sources import inventory as inv
from logquarry.sources import skip_index

from conftest import plan_of
from test_files import files_read, iter_leaves

WORDS = ["alpha", "beta", "gamma", "Delta", "straße", "ÉTÉ", "漢字かな", "100%", "under_score", "back\\slash", "tab\tbed", "q", "zw"]


def batch_key(number, folder="org/alice", kind="chat"):
    # Several files share a stamp.
    return f"{folder}/s{number % 3}_run-{number}_{kind}_0a_202506{14 + number // 24:02d}T{number // 2 % 12:02d}1500Z_u{number}.jsonl"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    return {number: [" ".join(rng.choices(WORDS, k=rng.randrange(1, 9))) for _ in range(rng.randrange(0, 5))] for number in range(40)}


@pytest.fixture
def root(put, texts):
    files = {}
    for number, bodies in texts.items():
        lines = [json.dumps({"id": f"e{number}-{at}", "type": "span", "body": body, "model": {"n": at}}, ensure_ascii=False) for at, body in enumerate(bodies)]
        if number % 5 == 0:
            lines.append("BROKEN{")
        files["logs/" + batch_key(number, "org/bob" if number % 4 == 0 else "org/alice", "review" if number % 6 == 0 else "chat")] = "\n".join(lines) + "\n"
    files["logs/org2/x/" + batch_key(3).rpartition("/")[2]] = '{"id":"other","type":"span","body":"alpha beta"}\n'
    files["logs/" + batch_key(39)] += '{"id":"own","type":"span","body":"alpha","key":"its own","model":[1]}\n'
    files["logs/org/alice/media/m1.bin"] = "alpha"
    files["logs/org/alice/notes.jsonl"] = "not an event\n"
    return put(files) + "/logs"


@pytest.fixture
def stored(spark, root, tmp_path):
    assert lq.update_inventory(spark, root, str(tmp_path / "inventory"), str(tmp_path / "stream")) == 43
    return lq.read_inventory(spark, str(tmp_path / "inventory"))


def rows(df, *columns):
    return [tuple(row) for row in (df.select(*columns) if columns else df).collect()]


def test_inventory_is_appended_to(spark, root, stored, tmp_path, put):
    listed = sorted(rows(lq.list_batches(spark, root)))
    assert sorted(rows(stored, "key", "length", "modified")) == listed
    days = {row["key"]: (row["org"], str(row["day"])) for row in stored.collect()}
    assert days[batch_key(25)] == ("org", "2025-06-15") and days["org/alice/notes.jsonl"] == ("org", "None")
    again = lambda: lq.update_inventory(spark, root, str(tmp_path / "inventory"), str(tmp_path / "stream"))
    assert again() == 0
    new = batch_key(90, "org/carol")
    put({"logs/" + new: '{"id":"n","type":"t"}\n'})
    assert again() == 1
    stored = lq.read_inventory(spark, str(tmp_path / "inventory"))
    assert sorted(rows(stored, "key")) == sorted([*((key,) for key, *_ in listed), (new,)])
    # One tenant with a stream of its own.
    own = [str(tmp_path / name) for name in ("carol", "carol-stream")]
    assert lq.update_inventory(spark, root, *own, "org/carol") == 1
    assert rows(lq.read_inventory(spark, own[0]), "key") == [(new,)]


def test_inventory_partitions_are_pruned(spark, stored):
    listed = lq.chosen_files(spark, "/nowhere", "org/alice", inventory=stored, start="2025-06-15")
    assert listed.count() == len([n for n in range(24, 40) if n % 4])
    plan = plan_of(listed)
    assert "isnotnull(org" in plan and "day" in plan.partition("PartitionFilters")[2][:200]


QUERIES = ["alpha", "ALPHA beta", "straße", "été", "字か", "%", "100%", "r_sc", "a%ma gam", "back\\sl", "q", "zw", "e1", "e1%-2", "span", "nothing like it", "*", "", "\tbed"]


@pytest.mark.parametrize("limit", [None, 0, 1, 7, 1000])
def test_search_equals_the_plain_one(spark, root, stored, limit, monkeypatch):
    monkeypatch.setattr(inv, "FIRST_FILES", 2)
    for q in ["alpha", "*", "a%ma gam", "nothing like it"]:
        for filters in [{}, {"start": "2025-06-14T05:15:00", "end": "2025-06-15T03:15:00"}, {"trace_type": "review", "is_org_admin": True}]:
            plain = rows(lq.search_files(spark, root, q, "org/alice", limit=limit, **filters))
            found = rows(lq.search_files(spark, root, q, "org/alice", limit=limit, inventory=stored, **filters))
            assert (sorted(found, key=str) == sorted(plain, key=str)) if limit is None else found == plain
    literal = lq.search_files(spark, root, "100%", "org/alice", wildcard=False, inventory=stored)
    assert rows(literal) == rows(lq.search_files(spark, root, "100%", "org/alice", wildcard=False))


def test_search_tells_what_it_chose_and_opened(spark, root, stored):
    found = lq.search_chosen_files(spark, root, "*", "org/alice", limit=3, inventory=stored)
    assert found.files_scanned.head()["files_scanned"] == found.keys.count() == 30
    assert sorted(rows(found.keys)) == sorted(rows(lq.list_files(spark, root, "org/alice")))
    few = list(inv.key_slices(lq.chosen_files(spark, root, "org/alice", inventory=stored), first=4, most=8))
    assert [len(some) for some in few] == [4, 8, 8, 8, 2]
    stamps = [key.split("_")[4] for some in few for key in some]
    assert stamps == sorted(stamps, reverse=True)
    assert [len(some) for some in inv.key_slices(stored.where("day is not null").withColumn("timestamp", F.col("day")), most_bytes=1)] == [1] * 41
    # Without an inventory the folder is listed for the same result.
    plain = lq.search_chosen_files(spark, root, "alpha", "org/alice", limit=None)
    assert plain.files_opened == 30 and sorted(rows(plain.rows)) == sorted(rows(lq.search_files(spark, root, "alpha", "org/alice", limit=None)))


def test_search_stops_early(spark, root, stored, monkeypatch):
    monkeypatch.setattr("logquarry.plans.search.key_slices", lambda keys: inv.key_slices(keys, first=2, most=4))
    found = lq.search_chosen_files(spark, root, "*", "org/alice", limit=3, inventory=stored)
    assert found.rows.count() == 3 and found.files_opened < 12
    found = lq.search_chosen_files(spark, root, "nothing like it", "org/alice", limit=3, inventory=stored)
    assert found.rows.count() == 0 and found.files_opened == 30
    assert found.rows.columns == ["id", "type", "timestamp", "body", "key"]


def test_no_folder_is_listed(spark, root, stored):
    """Only what the inventory names is there for a search; its files are opened by their own paths."""
    some = stored.where(F.col("key").isin(batch_key(1), batch_key(2)))
    found = lq.search_files(spark, root, "*", "org/alice", limit=None, inventory=some)
    assert files_read(found) == 2
    assert {row["key"] for row in found.collect()} == {batch_key(1), batch_key(2)}
    gone = some.withColumn("key", F.replace("key", F.lit("u1"), F.lit("u77")))
    with pytest.raises(AnalysisException):
        lq.search_files(spark, root, "*", "org/alice", inventory=gone)
    assert rows(lq.search_files(spark, root, "*", "org/alice", inventory=some.limit(0))) == []


def test_fields_of_the_events(spark, root, stored):
    extra = T.StructType([T.StructField("model", T.VariantType()), T.StructField("key", T.StringType())])
    how = {"limit": 5, "extra": extra}
    found = lq.search_files(spark, root, "alpha", "org/alice", inventory=stored, **how)
    plain = lq.search_files(spark, root, "alpha", "org/alice", **how)
    as_text = ["id", F.to_json("model"), "event_key"]
    assert rows(found, *as_text) == rows(plain, *as_text) and found.schema == plain.schema
    assert ("own", "[1]", "its own") in rows(found, *as_text)


def test_chosen_files_are_read_by_path(spark, root, stored):
    chosen = lq.list_files(spark, root, "org/alice", inventory=stored, trace_type="review")
    events = lq.read_files(spark, root, chosen)
    assert files_read(events) == chosen.count() < 10
    expected = filter_files(lq.read_events(spark, root), "org/alice", trace_type="review").select(*events.columns)
    assert sorted(rows(events)) == sorted(rows(expected))
    assert lq.read_files(spark, root, chosen.limit(0)).columns == events.columns
    parts = list(lq.scan_slices(spark, root, chosen, lq.read_export_events))
    with pytest.raises(Exception, match="FAILFAST|Malformed|MALFORMED"):
        parts[0].collect()
    assert manifest(chosen, "s3a://logs").count() == chosen.count()


def test_many_chosen_files(spark, put):
    """Of 2,400 files the 100 that a table of keys names are opened, and no other."""
    names = {f"many/org/u/s_r{at}_chat_0a_20250614T051500Z_u{at}.jsonl": f'{{"id":"e{at}","type":"t","body":"b"}}\n' for at in range(2400)}
    root = put(names) + "/many"
    chosen = lq.list_batches(spark, root).select("key").where(F.rlike("key", F.lit("_u[0-9]{1,2}.jsonl")))
    events = lq.read_files(spark, root, chosen)
    assert len(events.collect()) == 100
    leaves = list(iter_leaves(events._jdf.queryExecution().executedPlan()))
    assert sum(leaf.metrics().apply("numFiles").value() for leaf in leaves) == 100


def test_skip_index_equals_the_full_scan(spark, root, stored, tmp_path, texts):
    path = str(tmp_path / "index")
    assert lq.read_skip_index(spark, path).count() == 0
    assert lq.update_skip_index(spark, root, stored, path, files_at_once=16) == 41
    assert lq.update_skip_index(spark, root, stored, path) == 0
    index = lq.read_skip_index(spark, path)
    assert index.count() == 41
    for q in QUERIES:
        for wildcard in (True, False):
            plain = lq.search_files(spark, root, q, "org/alice", limit=None, wildcard=wildcard)
            found = lq.search_chosen_files(spark, root, q, "org/alice", limit=None, wildcard=wildcard, inventory=stored, index=index)
            assert sorted(rows(found.rows)) == sorted(rows(plain)), q
            held = {row["key"] for row in plain.collect()}
            assert found.files_opened >= len(held)
            if len(q) > 3 and not (wildcard and set(q) & set("%_")):
                # So few trigrams leave next to no bit to chance.
                assert found.files_opened <= len(held) + 2, q
    # A file the index does not know stays.
    part = index.where(F.col("key") != batch_key(1))
    unknown = lq.search_chosen_files(spark, root, "nothing like it", "org/alice", limit=None, inventory=stored, index=part)
    assert unknown.files_opened == 1


def test_bit_maps_fold_and_hold_their_rate(spark):
    """A quarter of the bits is used at most, whatever the size of the file, and false hits are as rare as that."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    big = ["".join(rng.choices(letters, k=3000)) for _ in range(20)]
    events = spark.createDataFrame([("1", "t", body, "big") for body in big] + [("2", "t", "little", "small"), ("3", None, None, "none")], "id string, type string, body string, key string")
    found = {row["key"]: row for row in skip_index.file_bits(events).collect()}
    assert found["small"]["pages"] == 1 and found["big"]["pages"] == 8 and "none" not in found
    used = sum(bin(byte).count("1") for page in found["big"]["bits"].values() for byte in page)
    assert used <= skip_index.FULL * 8 * skip_index.PAGE_BITS
    index = skip_index.file_bits(events.where("key = 'big'")).cache()
    held = {body[at : at + 3] for body in big for at in range(2998)}
    absent = [gram for gram in ("".join(rng.choices(letters, k=3)) for _ in range(400)) if gram not in held][:60]
    false = sum(index.where(skip_index.may_hold(skip_index.query_bits(spark, gram))).count() for gram in absent)
    assert len(absent) == 60 and false <= 60 * 0.25 * 2
    assert index.where(skip_index.may_hold(skip_index.query_bits(spark, big[7][100:140]))).count() == 1
    assert index.where(skip_index.may_hold(skip_index.query_bits(spark, "never there 漢字"))).count() == 0
    index.unpersist()


def test_bits_are_brought_together_as_numbers(spark):
    events = spark.createDataFrame([("f", "t", "some text", "k")], "id string, type string, body string, key string")
    plan = plan_of(skip_index._numbered_bits(events))
    # Trigrams are taken from a text once, and maps are made only behind the shuffles.
    assert plan.count("regexp_extract_all") == 1 and "partial_bitmap" not in plan.split("Exchange")[-1]


def test_given_paths_share_lookups(spark, put):
    root = put({f"r/{batch_key(number)}": '{"id":"a","type":"t","body":"b"}\n' for number in range(60)}) + "/r"
    spark.sparkContext.setJobGroup("lookups", "lookups")
    try:
        events = lq.read_events(spark, root, keys=[batch_key(number) for number in range(60)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [stage for job in tracker.getJobIdsForGroup("lookups") for stage in tracker.getJobInfo(job).stageIds]
    assert stages and sum(tracker.getStageInfo(stage).numTasks for stage in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert events.count() == 60
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_no_rows_runs_nothing(spark):
    empty = no_rows(spark, "a string, b map<int,binary>, c variant")
    assert empty.collect() == [] and empty.columns == ["a", "b", "c"]
    assert "LocalTableScan" in plan_of(empty)


def test_compacted_files_answer_like_the_files(spark, root, tmp_path, put):
    extra = T.StructType([T.StructField("key", T.StringType())])
    path, stream = str(tmp_path / "table"), str(tmp_path / "table-stream")
    lines = sum(len(text.split("\n")) - 1 for text in (open(f"{root}/{row['key']}").read() for row in lq.list_batches(spark, root).where("key like '%jsonl' and key not like '%notes%'").collect()) if text.strip())
    assert lq.compact_files(spark, root, path, stream, extra=extra, files_at_once=15) == lines
    events = lambda: lq.read_compacted(spark, path, extra=extra)
    for q in ["alpha", "*", "a%ma gam", "BROKEN"]:
        for filters in [{}, {"start": "2025-06-14T05:15:00", "end": "2025-06-15T03:15:00"}, {"trace_type": "review", "is_org_admin": True}]:
            plain = lq.search_files(spark, root, q, "org/alice", limit=9, extra=extra, **filters)
            assert rows(lq.search_files(spark, root, q, "org/alice", limit=9, extra=extra, events=events(), **filters)) == rows(plain)
    assert sorted(rows(lq.broken_compacted(spark, path))) == sorted(rows(lq.broken_lines(spark, root)))
    found = lq.search_files(spark, root, "*", "org/alice", limit=None, events=events(), extra=extra, start="2025-06-15")
    assert "org" in plan_of(found).partition("PartitionFilters")[2][:300]
    # A new file is added once.
    put({"logs/" + batch_key(90, "org/carol"): '{"id":"n","type":"t","body": {"b": 1,"a":2}}\n\n'})
    assert lq.compact_files(spark, root, path, stream, extra=extra) == 1
    assert lq.compact_files(spark, root, path, stream, extra=extra) == 0
    assert rows(lq.search_files(spark, root, '"b": 1', "org/carol", events=events()), "id", "body") == [("n", '{"b": 1,"a":2}')]


def test_typed_records(spark, put):
    lines = [
        {"id": "1", "type": "t", "body": {"n": 1, "deep": {"x": "a"}}, "tags": ["a"], "odd name`": 1, "quote\"": 2},
        {"id": "2", "type": "t", "body": {"n": 1.5, "more": None}, "tags": "b", "never": None, "empty": {}},
        {"id": "3", "type": "needle", "extra": [{"k": 1}], "quote\"": 3},
        {"id": 4, "body": "text with Needle"},
    ]
    names = [f"r/org/u/s_r{at}_chat_0a_20250614T051500Z_u{at}.jsonl" for at in range(4)]
    root = put({name: json.dumps(line) + "\n" for name, line in zip(names, lines)}) + "/r"
    records = lq.read_records(spark, root)
    schema = lq.record_schema(records)
    kinds = {field.name: field.dataType.simpleString() for field in schema}
    assert kinds == {"body": "variant", "empty": "variant", "extra": "array<struct<k:bigint>>", "id": "variant", "never": "variant",
                     "odd name`": "bigint", 'quote"': "bigint", "tags": "variant", "type": "string"}
    rows_of = {row["file_key"][-7:-6]: row.asDict() for row in lq.typed_records(records).orderBy("file_key").collect()}
    assert rows_of["0"]["odd name`"] == 1 and rows_of["2"]['quote"'] == 3 and rows_of["2"]["extra"][0]["k"] == 1 and rows_of["1"]["extra"] is None
    some = lq.read_records(spark, root, keys=[names[0][2:], names[1][2:]])
    typed = lq.typed_records(some)
    assert typed.schema["body"].dataType.simpleString() == "struct<deep:struct<x:string>,more:variant,n:decimal(21,1)>"
    assert sorted(float(row["body"]["n"]) for row in typed.collect()) == [1.0, 1.5]
    found = lambda q: sorted(row["file_key"][-7:-6] for row in lq.search_records(records, q).collect())
    assert found("needle") == ["2", "3"] and found('"N":1') == ["0", "1"] and found("*") == ["0", "1", "2", "3"] and found("4") == ["3"]
    assert lq.search_records(records, "no such").columns == [*kinds, "file_key", "file_timestamp"]
    assert lq.typed_records(records.limit(0)).columns == ["file_key"]


def test_media_table(spark, put, tmp_path):
    sidecar = '{\n "contentType": "image/png",\n "contentLength": 5\n}'
    root = put({"m/org/u/media/a.meta.json": sidecar, "m/org/u/media/a.bin": "x", "m/org/v/media/b.meta.json": sidecar, "m/org/v/other.meta.json": "{}"}) + "/m"
    table, stream = str(tmp_path / "media"), str(tmp_path / "media-stream")
    lq.update_media_table(spark, root, table, stream)
    requests = spark.createDataFrame([("org/u", "a"), ("org/v", "b"), ("org/v", "b"), ("org/v", "gone"), ("../org/u", "a"), ("/org", "a"), (None, "a"), ("o*", "a")], "project_id string, media_id string")
    stored = lambda: lq.read_media_table(spark, table)
    found = lq.media_for(spark, root, requests, "s3a://b", media=stored())
    listed = lq.media_for(spark, root, requests, "s3a://b")
    assert found.columns == listed.columns
    assert sorted(rows(found, "blob_key", "url")) == sorted(rows(listed, "blob_key", "url")) == [("org/u/media/a.bin", "s3a://b/org/u/media/a.bin"), ("org/v/media/b.bin", "s3a://b/org/v/media/b.bin")]
    put({"m/org/w/media/c.meta.json": sidecar})
    lq.update_media_table(spark, root, table, stream)
    lq.update_media_table(spark, root, table, stream)
    assert sorted(rows(stored(), "media_id")) == [("a",), ("b",), ("c",)]


def test_lookups_skip_row_groups(spark, tmp_path):
    events = spark.range(40_000).select(
        F.concat(F.lit("ev"), "id").alias("event_id"), F.lit("t").alias("event_type"),
        F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("timestamp"),
        F.when(F.col("id") % 10 < 7, F.lit("big/u")).otherwise(F.concat(F.lit("org"), F.col("id") % 10, F.lit("/u"))).alias("project_id"),
        F.lit("m").alias("model"), F.lit("n").alias("name"), F.md5((F.col("id") % 9000).cast("string")).alias("trace_id"),
        F.md5(F.col("id").cast("string")).alias("session_id"), F.lit("{}").alias("body"),
    )
    path = str(tmp_path / "events")
    events = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        lq.write_event_table(events, path, group_bytes=64 << 10, group_ids=2_000)
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    table = spark.read.parquet(path)
    assert table.count() == 40_000

    def scanned(df):
        got = df.collect()
        leaf = next(iter(iter_leaves(df._jdf.queryExecution().executedPlan())))
        return len(got), leaf.metrics().apply("numOutputRows").value()

    some = table.where("event_id = 'ev4217'").head()
    found, read = scanned(lq.ids(table, trace_id=some["trace_id"]))
    assert found == len([n for n in range(4217 % 9000, 40_000, 9000)]) and read < 20_000
    found, read = scanned(lq.ids(table, session_id=some["session_id"]))
    assert found == 1 and read < 8_000
    assert scanned(lq.ids(table, session_id="not there at all"))[0] == 0
    found, read = scanned(lq.time_range(lq.tenant(table, "big/u", org_col="org"), "2024-01-01T01:00:00", "2024-01-01T01:00:59", date_col="day"))
    assert found == 42 and read < 8_000

    traces = events.select(F.col("event_id").alias("id"), "timestamp", F.col("session_id").alias("sessionId"), F.col("name"))
    lq.write_traces(traces, str(tmp_path / "traces"), group_bytes=64 << 10, group_ids=2_000)
    stored = lq.scan_traces(spark, str(tmp_path / "traces"), fmt="parquet")
    found, read = scanned(lq.search_traces(stored, "*", trace_id="ev4217").select("id"))
    assert found == 1 and read < 8_000


def test_selected_events_scan_once(spark):
    events = spark.range(100).select(F.col("id").cast("string").alias("id"))
    none = events.where("false")
    assert lq.select_events(events, none).count() == 100
    picked = lq.select_events(events, events.where("id < '3'"))
    assert picked.count() == events.where("id < '3'").count() and "Union" not in plan_of(picked)
    assert lq.select_events(events, events.select(F.lit(None).cast("string").alias("id"))).count() == 100
