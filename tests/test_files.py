import json
import re

import pytest
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import functions as F
from pyspark.sql import types as T

import logquarry as lq

from conftest import plan_of

STAMP = "20250614T{}1500Z"


def key(session, trace, hour, folder="org/alice", kind="chat", unique="u.jsonl"):
    return f"{folder}/{session}_{trace}_{kind}_0a_{STAMP.format(hour)}_{unique}"


A1, A2, B1 = key("dawn", "req-7", "05"), key("dawn", "req-8", "09"), key("dusk", "req-7", "21")
BOB = key("dawn", "req-7", "07", "org/bob")
DEEP = key("noon", "req-9", "07", "org/alice/deep", "review")
OTHER = key("dawn", "req-7", "05", "org2/alice")


def line(number, **more):
    return json.dumps({"id": f"e{number}", "type": "span", "body": {"text": f"Body {number}"}} | more)


@pytest.fixture
def root(put):
    return put(
        {
            A1: line(1) + "\n" + line(2) + "\nBROKEN{\n\n" + '{"id":"e9","type":\n',
            A2: '{"id":3,"type":"gen","body":{"b": 1,"a":2},"model":"m"}\n',
            B1: '{"id":"e4"}\n',
            BOB: line(5) + "\n",
            DEEP: line(6) + "\n",
            OTHER: line(7) + "\n",
            "org/alice/media/m1.meta.json": '{\n "contentType": "image/png",\n "contentLength": 5\n}',
            "org/alice/media/m1.bin": "12345",
            "org/alice/notes.jsonl": "not an event\n",
        }
    )


def keys(df):
    return sorted(r["key"] for r in df.select("key").collect())


def files_read(df):
    """How many files the scan opened."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    for leaf in iter_leaves(plan):
        metrics = leaf.metrics()
        if metrics.contains("numFiles"):
            return metrics.apply("numFiles").value()
    raise AssertionError("no file scan in the plan")


def iter_leaves(plan):
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        plan = plan.plan()
    children = plan.children()
    if children.isEmpty():
        yield plan
    for i in range(children.size()):
        yield from iter_leaves(children.apply(i))


def test_inventory(spark, root):
    listed = lq.list_batches(spark, root)
    assert len(keys(listed)) == 9
    assert "content" not in re.search("ReadSchema.*", plan_of(listed.select("key"))).group()
    assert {r["key"]: r["length"] for r in listed.collect()}["org/alice/media/m1.bin"] == 5


def test_list_files(spark, root):
    assert keys(lq.list_files(spark, root, "org/alice")) == sorted([A1, A2, B1, DEEP])
    assert keys(lq.list_files(spark, root, "org/alice", is_org_admin=True)) == sorted([A1, A2, B1, BOB, DEEP])
    assert keys(lq.list_files(spark, root, "org")) == sorted([A1, A2, B1, BOB, DEEP])

    def found(**filters):
        return keys(lq.list_files(spark, root, "org/alice", **filters))

    assert found(start="2025-06-14T09:15:00") == sorted([A2, B1])
    assert found(start="2025-06-14T05:15:00.000001", end="2025-06-14T09:14:59") == [DEEP]
    assert found(end="2025-06-14T07:15:00+02:00") == [A1]
    assert found(session_id="noon", trace_id="req-9") == [DEEP]
    assert found(session_id="dusk", trace_id="req-8") == []
    assert found(trace_id="req-7", end="2025-06-14T20:00:00") == [A1]
    assert found(trace_type="review") == [DEEP]
    assert found(input_hash="ff") == []
    row = lq.list_files(spark, root, "org/alice", session_id="dusk").head().asDict()
    assert row == {"key": B1, "session_id": "dusk", "trace_id": "req-7", "trace_type": "chat", "input_hash": "0a",
                   "timestamp": "2025-06-14T21:15:00+00:00"}


def test_missing_tenant_is_empty(spark, root):
    assert lq.list_files(spark, root, "nobody/x").collect() == []
    found = lq.search_files(spark, root, "x", "nobody/x")
    assert found.collect() == [] and found.columns == ["id", "type", "timestamp", "body", "key"]
    assert lq.read_records(spark, root, "nobody").collect() == []
    assert lq.broken_lines(spark, root, "nobody").collect() == []
    assert lq.read_media_meta(spark, root, "nobody").collect() == []
    assert lq.scan_stats(lq.list_files(spark, root, "nobody/x")).head()["files_scanned"] == 0


def test_relative_root_is_an_error(spark):
    with pytest.raises(ValueError):
        lq.list_batches(spark, "logs")


def test_search(spark, root):
    def ids(q, **options):
        return [r["id"] for r in lq.search_files(spark, root, q, "org/alice", **options).collect()]

    assert ids("*") == ["e4", "3", "e6", "e1", "e2"]
    assert ids("body 2") == ["e2"]
    assert ids("GEN") == ["3"]
    assert ids("E4") == ["e4"]
    assert ids('"b": 1,"a"') == ["3"]
    assert ids("null") == []
    assert ids("*", limit=2) == ["e4", "3"]
    assert sorted(ids("body", newest_first=False)) == ["e1", "e2", "e6"]
    assert ids("*", session_id="nope") == []
    assert ids("body", is_org_admin=True, session_id="dawn", end="2025-06-14T08:00:00Z") == ["e5", "e1", "e2"]


def test_extra_fields(spark, root):
    model = T.StructType([T.StructField("model", T.StringType())])
    rows = lq.search_files(spark, root, "*", "org/alice", extra=model).collect()
    assert [r["model"] for r in rows] == [None, "m", None, None, None]


def test_only_matching_files_are_opened(spark, root):
    everything = lq.search_files(spark, root, "*", "org/alice")
    assert files_read(everything) == 4
    assert files_read(lq.search_files(spark, root, "*", "org/alice", session_id="dawn", trace_id="req-8")) == 1
    assert files_read(lq.search_files(spark, root, "*", "org/alice", start="2025-06-14T09:00:00")) == 2
    assert files_read(lq.select_files(lq.read_events(spark, root), [A1, B1])) == 2
    assert files_read(lq.list_files(spark, root, "org/alice")) == 4
    assert files_read(lq.list_files(spark, root, "org/alice", session_id="dusk")) == 1
    assert "TakeOrderedAndProject" in plan_of(everything)
    assert "Python" not in plan_of(everything)


def test_broken_lines(spark, root):
    assert [r.asDict() for r in lq.broken_lines(spark, root).collect()] == [{"key": A1, "broken": 2}]
    good = lq.select_files(lq.read_events(spark, root, strict=True), [A2, B1])
    assert good.count() == 2
    with pytest.raises(Exception, match="MALFORMED"):
        lq.select_files(lq.read_events(spark, root, strict=True), [A1]).collect()
    with pytest.raises(Exception, match="MALFORMED"):
        lq.select_files(lq.read_export_events(spark, root), [A1]).collect()


def test_records_keep_every_field(spark, root):
    rows = lq.select_files(lq.read_records(spark, root), [A1, A2])
    found = {r[0]: json.loads(r[1]) for r in rows.select("id", F.to_json("record")).collect()}
    assert set(found) == {"e1", "e2", "3"}
    assert found["3"] == {"id": 3, "type": "gen", "body": {"a": 2, "b": 1}, "model": "m"}


def test_both_scans_give_the_same_keys(spark, put):
    names = [key("a b", "t+1", 10), key("a%41", "t", 11), key("a+b", "ü", 12), key("a[1]{2}", "t", 13)]
    root = put({name: line(1) + "\n" for name in names})
    assert keys(lq.list_batches(spark, root)) == keys(lq.read_events(spark, root)) == sorted(names)
    assert keys(lq.list_batches(spark, f"file:{root}/")) == sorted(names)
    assert keys(lq.read_events(spark, f"file://{root}", "org/alice")) == sorted(names)


def test_selection_sizes(spark, root):
    events = lq.read_events(spark, root, "org/alice")
    chosen = lq.list_files(spark, root, "org/alice", session_id="dawn")
    assert sorted(r["id"] for r in lq.select_files(events, chosen).collect()) == ["3", "e1", "e2"]
    assert lq.select_files(events, chosen).columns == lq.select_files(events, [A1]).columns == events.columns
    assert lq.select_events(events, events.where("id = 'e1'").select("id")).count() == 1
    assert lq.select_events(events, events.where("false").select("id")).count() == events.count()
    many = spark.range(5000).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"))
    assert lq.select_events(events, many).count() == lq.select_events(events, [r["id"] for r in many.collect()]).count()
    assert lq.select_files(events, []).count() == 0
    assert lq.select_events(events, []).count() == events.count()
    assert lq.select_events(events, ["e1", "e6", "gone"]).count() == 2
    assert "Join" in plan_of(lq.select_files(events, chosen))
    assert sorted(r["id"] for r in lq.select_files(events, chosen).collect()) == ["3", "e1", "e2"]
    assert lq.select_events(events, ["e1", "e6", "gone", "e1"]).count() == 2


def test_manifest_and_ownership(spark, root):
    from datetime import datetime

    wanted = spark.createDataFrame([(A1,), (BOB,), (OTHER,)], "key string")
    rows = lq.locate(wanted, "org/alice", "http://in/b/", internal_uri="http://in", public_uri="https://out").collect()
    assert [tuple(r) for r in rows] == [(A1, f"https://out/b/{A1}")]
    assert lq.locate(wanted, "org/alice", "s3a://b", is_org_admin=True).count() == 2
    row = lq.manifest(lq.list_files(spark, root, "org/alice", session_id="dusk"), "s3a://b", ttl_seconds=90,
                      now=datetime(2025, 6, 14)).head()
    assert (row["url"], row["url_expiry"]) == (f"s3a://b/{B1}", "2025-06-14T00:01:30+00:00")
    assert lq.manifest(wanted).columns == ["key"]


def test_media(spark, put):
    def sidecar(length, **more):
        return json.dumps({"contentType": "image/png", "contentLength": length} | more, indent=1)

    root = put(
        {
            "a/b/media/m1.meta.json": sidecar(1, uploadedAt="2025-06-14T09:00:00+05:00"),
            "a/b/media/m[1]*.meta.json": sidecar(2),
            "a/b/media/m1.bin": "x",
            "a/c/media/m1.meta.json": sidecar(3, uploadedAt="2025-06-14T09:00:00"),
            "bad/t/media/m1.meta.json": sidecar(3, uploadedAt="not a time"),
            "bad/u/media/m1.meta.json": "{broken",
            "a/b/m9.meta.json": sidecar(9),
        }
    )
    rows = {(r["project_id"], r["media_id"]): r for r in lq.read_media_of(spark, root, ["a/b", "a/c", "no/one"]).collect()}
    assert set(rows) == {("a/b", "m1"), ("a/b", "m[1]*"), ("a/c", "m1")}
    for tenant in ("bad/t", "bad/u"):
        with pytest.raises(SparkRuntimeException if tenant == "bad/t" else Exception):
            lq.read_media_meta(spark, root, tenant).collect()
    assert lq.read_media_meta(spark, root, "a/b").count() == 2

    def one(media_id, tenant="a/b"):
        found = lq.media(spark, root, tenant, media_id, "http://in/b", internal_uri="http://in", public_uri="https://out")
        return found.withColumn("uploaded_at", lq.iso_utc(F.col("uploaded_at"))).collect()

    [row] = one("m1")
    assert (row["content_type"], row["content_length"], row["uploaded_at"]) == ("image/png", 1, "2025-06-14T04:00:00+00:00")
    assert row["url"] == "https://out/b/a/b/media/m1.bin"
    assert [r["content_length"] for r in one("m[1]*")] == [2]
    assert [r["uploaded_at"] for r in one("m1", "a/c")] == ["2025-06-14T09:00:00+00:00"]
    assert one("m[1]*")[0]["uploaded_at"] is None
    assert one("m2") == [] and one("m?") == []
    with pytest.raises(ValueError):
        one("../../c/media/m1")
    requests = spark.createDataFrame([("a/b", "m1"), ("a/c", "m1"), ("a/c", "m1"), ("a/c", "m7")], "project_id string, media_id string")
    assert lq.media_for(spark, root, requests, "s3a://b").count() == 2


def test_named_file_sources(spark, root):
    lake = lq.Source("lake", "files", root=root, base_uri="http://in/b", internal_uri="http://in", public_uri="https://out")
    assert keys(lq.list_source_files(spark, lake, "org/alice", session_id="dusk")) == [B1]
    day = {"start": "2025-06-14T21:00:00", "end": "2025-06-14T22:00:00"}
    [row] = lq.list_source_files(spark, lake, "org/alice", with_uri=True, **day).collect()
    assert row["url"] == f"https://out/b/{B1}"
    with pytest.raises(ValueError):
        lq.list_source_files(spark, lake, "org/alice", with_uri=True, start="2025-06-14")
    wanted = spark.createDataFrame([(A1,), (OTHER,)], "key string")
    assert keys(lq.locate_source_files(lake, wanted, "org/alice")) == [A1]
    [row] = lq.source_media(spark, lake, "org/alice", "m1").collect()
    assert (row["url"], row["content_length"]) == ("https://out/b/org/alice/media/m1.bin", 5)
    with pytest.raises(ValueError):
        lq.list_source_files(spark, lq.Source("t", "table"), "org/alice")


def test_media_and_own_fields_do_not_mix_with_events(spark, put):
    root = put(
        {
            A1: '{"id":"e1","type":"t","body":"b","trace_id":"LINE","timestamp":"own"}\n',
            "org/alice/media/m1.bin": '{"id":"x","type":"t","body":"b"}\n',
            "org/alice/media/m1.meta.json": '{"contentType":"a","contentLength":1}\n',
        }
    )
    own = T.StructType([T.StructField("trace_id", T.StringType()), T.StructField("timestamp", T.StringType())])
    [row] = lq.search_files(spark, root, "*", "org/alice", extra=own).collect()
    assert (row["trace_id"], row["event_timestamp"], row["key"]) == ("LINE", "own", A1)
    assert [r["id"] for r in lq.read_events(spark, root).collect()] == ["e1"]
    assert lq.read_records(spark, root).count() == 1
    assert lq.read_export_events(spark, root, "org/alice").count() == 1


def test_missing_root_is_an_error(spark, tmp_path):
    for read in (lq.list_batches, lq.read_events, lq.read_records):
        with pytest.raises(AnalysisException):
            read(spark, str(tmp_path / "gone")).collect()


def test_inventory(spark, root):
    stored = spark.createDataFrame([(A1,), (BOB,), ("x",)], "key string")
    assert keys(lq.list_files(spark, root, "org/alice", inventory=stored)) == [A1]


def test_broken_and_naive_traces(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id":"a","timestamp":"2025-06-14T12:00:00"}\nBROKEN{\n')
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            traces = lq.scan_traces(spark, str(tmp_path))
            found = lq.search_traces(traces, "*", start="2025-06-14T11:00:00", end="2025-06-14T13:00:00")
            assert [r["id"] for r in found.collect()] == ["a"]
            table = spark.createDataFrame([("2025-06-14T12:00:00",)], "timestamp string")
            assert lq.time_range(table, "2025-06-14T11:59:00", "2025-06-14T12:01:00Z").count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    with pytest.raises(Exception, match="MALFORMED"):
        lq.scan_traces(spark, str(tmp_path), strict=True).collect()
    with pytest.raises(ValueError):
        lq.search_traces(spark.createDataFrame([("a",)], "id string"), "*", project_id="o/u")
