import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import logquarry as lq
from logquarry.sources.registry import Source, Sources
from logquarry.sources.tables import table_name

from conftest import plan_of

EVENTS = "event_id string, event_type string, timestamp timestamp_ntz, project_id string, model string, name string, trace_id string, session_id string, input_hash string, body string"


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (f"e{n}", "llm.completion", f"2026-03-01 1{n}:00:00", tenant, "m", kind, f"t{n}", f"s{n % 2}", f"h{n}", body)
        for n, (tenant, kind, body) in enumerate(
            [
                ("org/a", "chat", '{"q":"Hello"}'),
                ("org/b", "chat", '{"q":"hello"}'),
                ("org2/a", "qa", '{"q":"hello"}'),
                ("org/a", "qa", "{broken hello"),
                ("org/a", "chat", None),
            ]
        )
    ]
    text = EVENTS.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, text).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def found(df):
    return [r["id"] for r in df.collect()]


def test_search_table(events):
    assert found(lq.search_table(events, "HELLO", "org/a")) == ["e3", "e0"]
    assert found(lq.search_table(events, "Hello", "org/a", case=True)) == ["e0"]
    assert found(lq.search_table(events, "hello", "org/a", is_org_admin=True)) == ["e3", "e1", "e0"]
    assert found(lq.search_table(events, "*", "org/a", limit=2)) == ["e4", "e3"]
    assert found(lq.recent(events, "org/a", trace_type="chat")) == ["e4", "e0"]
    assert found(lq.search_table(events, "*", "org/a", is_org_admin=True, session_id="s1", input_hash="h3")) == ["e3"]
    assert found(lq.search_table(events, "*", "org/a", start="2026-03-01T13:00:00", end="2026-03-01T13:00:00")) == ["e3"]
    rows = lq.search_table(events, "*", "org/a").collect()
    assert rows[0].asDict().keys() == {"id", "type", "timestamp", "body"}
    assert [r["body"] for r in rows] == ["{}", "{}", '{"q":"Hello"}']


def test_pushdown_and_partition_pruning(spark, events, tmp_path):
    path = str(tmp_path / "events")
    layout = events.withColumn("org", F.substring_index("project_id", "/", 1)).withColumn("day", F.to_date("timestamp"))
    layout.write.partitionBy("org", "day").parquet(path)
    table = lq.scan_event_table(spark, path=path)
    search = lq.search_table(table, "hello", "org/a", start="2026-03-01", session_id="s1", org_col="org", date_col="day")
    assert found(search) == ["e3"]
    plan = plan_of(search)
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("EqualTo(project_id,org/a)", "GreaterThanOrEqual(timestamp", "EqualTo(session_id,s1)"):
        assert part in pushed
    partitions = plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert "org#" in partitions and "day#" in partitions
    assert "model" not in pushed[pushed.index("ReadSchema") :]
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Python" not in plan
    below_limit = plan[plan.index("TakeOrderedAndProject") :].partition("\n")[2]
    assert "from_json" not in below_limit
    admin = plan_of(lq.search_table(table, "*", "org/a", is_org_admin=True))
    assert "StringStartsWith(project_id,org/)" in admin


def test_table_names(spark, events):
    assert table_name("t", "db") == "`db`.`t`"
    assert table_name("t", "s", "c") == "`c`.`s`.`t`"
    assert table_name("t", "s", "") == table_name("t", "", "c") == table_name("t") == "`t`"
    events.createOrReplaceTempView("wide_events")
    assert lq.scan_event_table(spark, "wide_events").count() == 5
    with pytest.raises(ValueError):
        lq.scan_event_table(spark)


def test_named_sources(spark, events, put):
    events.createOrReplaceTempView("wide_events")
    root = put({"org/a/s_t_chat_h_20260301T120000Z_u.jsonl": '{"id":"x","body":"Hello"}\n'})
    sources = Sources(
        [
            Source("lake", "files", root=root),
            Source("wide", "table", options={"table": "wide_events"}),
            Source("exact", "table", options={"table": "wide_events"}, case_sensitive=True),
            Source("lake", "table"),
            Source("odd", "queue"),
        ]
    )
    assert found(lq.search(spark, sources.resolve("lake"), "hello", "org/a")) == ["x"]
    assert found(lq.search(spark, sources.resolve("wide"), "HELLO", "org/a")) == ["e3", "e0"]
    assert found(lq.search(spark, sources.resolve("exact"), "HELLO", "org/a")) == []
    with pytest.raises(KeyError):
        sources.resolve("gone")
    with pytest.raises(ValueError):
        sources.resolve("wide", "files")
    with pytest.raises(ValueError):
        lq.search(spark, sources.resolve("odd"), "x", "org/a")
    with pytest.raises(ValueError):
        lq.search(spark, sources.resolve("wide"), "", "org/a")


TRACES = [
    {"id": "t1", "name": "chat", "timestamp": "2026-03-01T10:00:00Z", "sessionId": "s", "input": {"b": 1, "a": "Needle"},
     "tags": ["x"], "latency": 1.5, "totalCost": 0.25, "usage": {"n": 1}, "project_id": "org/a"},
    {"id": "t2", "name": None, "timestamp": "2026-03-01T11:00:00Z", "sessionId": "s", "input": "needle %", "output": None},
    {"id": "t3", "name": "Needle-bot", "timestamp": "2026-03-01T12:00:00Z", "sessionId": "r", "metadata": [1]},
]


@pytest.fixture
def traces(spark, put):
    root = put({"traces/a.json": "\n".join(map(json.dumps, TRACES))})
    return lq.scan_traces(spark, f"{root}/traces")


def test_search_traces(traces):
    def ids(q, **options):
        return found(lq.search_traces(traces, q, **options))

    assert ids("*") == ["t3", "t2", "t1"]
    assert ids("NEEDLE") == ["t3", "t2", "t1"]
    assert ids("needle", limit=1) == ["t3"]
    assert ids("chat", limit=1) == ["t1"]
    assert ids("chat", limit=1, pre_limit=True) == []
    assert ids("e %") == ["t2"]
    assert ids("n%e") == []
    assert ids("*", trace_type="chat") == ["t1"]
    assert ids("*", session_id="s", end="2026-03-01T10:30:00") == ["t1"]
    assert ids("*", trace_id="t2", session_id="other", start="2030-01-01", limit=5) == ["t2"]
    assert ids("*", trace_id="t2", trace_type="chat") == []
    assert ids("*", input_hash="ignored") == ["t3", "t2", "t1"]
    assert ids("*", project_id="org/z", is_org_admin=True) == ["t1"]
    with pytest.raises(ValueError):
        ids("*", limit=-1)


def test_trace_shape(spark, traces):
    rows = {r["id"]: r for r in lq.trace_rows(traces).withColumn("usage", F.to_json("usage")).collect()}
    first = rows["t1"]
    assert json.loads(first["body"]) == {"input": {"a": "Needle", "b": 1}, "output": None, "metadata": None}
    assert (first["type"], first["trace_id"], first["session_id"], first["tags"]) == ("trace", "t1", "s", ["x"])
    assert (first["latency"], first["total_cost"], first["usage"]) == (1.5, 0.25, '{"n":1}')
    assert rows["t2"]["name"] is None and rows["t2"]["tags"] == []
    assert json.loads(rows["t2"]["body"])["input"] == "needle %"
    bare = lq.trace_rows(spark.createDataFrame([("x",)], "id string")).head()
    assert (bare["name"], bare["session_id"], bare["tags"], bare["body"]) == ("", "", [], '{"input":null,"output":null,"metadata":null}')


def lines(path):
    return [line for part in sorted(Path(path).glob("part-*")) for line in part.read_text().splitlines()]


def test_event_exports(spark, events, tmp_path):
    path = str(tmp_path / "out")
    assert lq.export_jsonl(lq.recent(events, "org/a"), path) == 3
    written = [json.loads(line) for line in lines(path)]
    assert written[2] == {"id": "e0", "type": "llm.completion", "timestamp": "2026-03-01T10:00:00.000000", "body": {"q": "Hello"}}
    assert written[0]["body"] == {}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        lq.export_jsonl(events, path)
    plain = spark.createDataFrame([("a string",), ("[1]",)], "body string")
    assert lq.export_catalog(plain, path, mode="overwrite") == 2
    assert {json.dumps(json.loads(line)["body"]) for line in lines(path)} == {'"a string"', "[1]"}


def test_record_catalog(spark, put, tmp_path):
    record = {"id": 1, "zeta": [1, {"a": None}], "body": "x"}
    root = put({"in/a/s_t_chat_h_20260301T120000Z_u.jsonl": json.dumps(record) + "\n{oops\n"})
    assert lq.export_catalog(lq.read_records(spark, f"{root}/in"), str(tmp_path / "out")) == 1
    assert [json.loads(line) for line in lines(tmp_path / "out")] == [record]


def test_index_exports(spark, tmp_path):
    df = lq.manifest(spark.createDataFrame([("k",)], "key string"), "s3a://b")
    assert lq.export_index(df, str(tmp_path / "a")) == 1
    assert lines(tmp_path / "a") == ['{"key":"k","url":"s3a://b/k"}']
    lq.export_index(df, str(tmp_path / "b"), with_key=False)
    assert lines(tmp_path / "b") == ['{"url":"s3a://b/k"}']


def test_dataset_export_from_files(spark, put, tmp_path):
    talk = {"input": [{"role": "user", "content": "u", "x": 1}], "output": {"role": "assistant", "content": ["a"]}}
    root = put(
        {
            "in/org/a/s_t_chat_h_20260301T120000Z_u.jsonl": "\n".join(
                json.dumps(e)
                for e in ({"id": 1, "body": talk}, {"id": 2} | talk, {"id": 3, "body": json.dumps(talk)}, {"id": 4, "body": {}} | talk,
                          {"id": 5, "body": 0} | talk, {"id": 6})
            )
        }
    )
    events = lq.read_export_events(spark, f"{root}/in", "org/a")
    assert lq.export_dataset(events, str(tmp_path / "out")) == 3
    message = [{"role": "user", "content": "u"}, {"role": "assistant", "content": ["a"]}]
    assert [json.loads(line) for line in lines(tmp_path / "out")] == [{"messages": message}] * 3
