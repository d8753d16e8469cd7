import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import logquarry as lq
from logquarry.functions.times import trunc_ms

from conftest import plan_of


def tenants(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "project_id string")


def seen(df):
    return sorted(r[0] for r in df.collect())


def test_tenant(spark):
    df = tenants(spark, "a_b/x", "axb/y", "a_b", "a_b/y", "other")
    assert seen(lq.tenant(df, "a_b/x")) == ["a_b/x"]
    assert seen(lq.tenant(df, "a_b/x", True)) == ["a_b/x", "a_b/y"]
    assert seen(lq.tenant(df, "a_b", True)) == ["a_b"]


def test_tenant_files(spark):
    keys = spark.createDataFrame([("acme/alice/f",), ("acme2/f",), ("acme/f",), ("acme",)], "key string")
    assert seen(lq.tenant_files(keys, "acme")) == ["acme/alice/f", "acme/f"]
    assert seen(lq.owned(keys, "acme/alice")) == ["acme/alice/f"]
    assert seen(lq.owned(keys, "acme/alice", True)) == ["acme/alice/f", "acme/f"]
    assert seen(lq.owned(keys, "acme", True)) == ["acme/alice/f", "acme/f"]


@pytest.mark.parametrize("bad", ["../x", "*", "a b", "/etc", ""])
def test_unsafe_tenant_is_refused(spark, bad):
    with pytest.raises(ValueError):
        lq.tenant_files(spark.createDataFrame([], "key string"), bad)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "string"])
def test_bounds_are_inclusive_instants(spark, kind):
    times = ["2026-03-01 10:00:00", "2026-03-01 12:00:00.000001", "2026-03-01 14:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast(kind).alias("timestamp"))

    def count(start=None, end=None):
        return lq.time_range(df, start, end).count()

    assert count() == 3
    assert count("2026-03-01T10:00:00", "2026-03-01T14:00:00Z") == 3
    assert count(datetime(2026, 3, 1, 11), datetime(2026, 3, 1, 13)) == 1
    assert count(start="2026-03-01T17:00:00.000001+05:00") == 2
    assert count(start="2026-03-01T17:00:00.000002+05:00") == 1
    assert count(end="2026-03-01T12:00:00") == 1


def test_bound_on_other_type_is_an_error(spark):
    with pytest.raises(TypeError):
        lq.time_range(spark.range(1).withColumnRenamed("id", "timestamp"), "2026-01-01")


def test_ids_left_unset_add_nothing(spark):
    df = spark.createDataFrame([("s", "t", "k", "h"), ("s", "u", "k", "h")], "session_id string, trace_id string, trace_type string, input_hash string")
    assert lq.ids(df).count() == 2
    assert lq.ids(df, session_id="s", trace_id="u", trace_type="k", input_hash="h").count() == 1
    assert lq.ids(df, session_id="", input_hash="x").count() == 0


@pytest.mark.parametrize(
    "query, options, hits",
    [
        ("HELLO", {}, {"hello", "a hello\nworld"}),
        ("HELLO", {"case": True}, set()),
        ("hello", {"case": True}, {"hello", "a hello\nworld"}),
        ("\\b", {}, {"x\\by"}),
        ("\\b_", {}, {"x\\by"}),
        ("%", {}, {"hello", "a hello\nworld", "x\\by", "abc", "50%", "Ünï"}),
        ("_____", {}, {"hello", "a hello\nworld"}),
        ("a%c", {}, {"abc"}),
        ("lo%wor", {}, {"a hello\nworld"}),
        ("%", {"wildcard": False}, {"50%"}),
        ("_", {"wildcard": False}, set()),
        ("üNÏ", {}, {"Ünï"}),
        ("*", {}, {"hello", "a hello\nworld", "x\\by", "abc", "50%", "Ünï", None}),
        (None, {}, {"hello", "a hello\nworld", "x\\by", "abc", "50%", "Ünï", None}),
    ],
)
def test_text(spark, query, options, hits):
    rows = ["hello", "a hello\nworld", "x\\by", "abc", "50%", "Ünï", None]
    df = spark.createDataFrame([(r,) for r in rows], "body string")
    assert {r[0] for r in lq.text(df, query, **options).collect()} == hits


def test_text_over_columns(spark):
    df = spark.createDataFrame([(None, "evt-1", "x"), ("b", None, "chat"), ("b", "c", None)], "body string, id string, type string")
    assert lq.text(df, "EVT", ["body", "id", "type"]).count() == 1
    assert lq.text(df, "cha", ["body", "id", "type"]).count() == 1


def test_presets():
    now = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
    assert lq.preset("all", now) == (None, None)
    for name, span in {"15m": 900, "1h": 3600, "4h": 14400, "24h": 86400, "7d": 604800, "30d": 2592000}.items():
        assert lq.preset(name, now) == (now - timedelta(seconds=span), now)
    with pytest.raises(ValueError):
        lq.preset("2h", now)


def test_millisecond_cut(spark):
    row = spark.sql("SELECT TIMESTAMP'2026-03-01 12:00:00.123999Z' AS t").select(lq.iso_utc(trunc_ms(F.col("t"))))
    assert row.head()[0] == "2026-03-01T12:00:00.123000+00:00"


def test_row_filters_run_on_a_stream(spark, put, tmp_path):
    root = put({"in/a.json": '{"project_id":"a/b","body":"Hello"}\n{"project_id":"c","body":"Hello"}\n'})
    stream = spark.readStream.schema("project_id string, body string").json(f"{root}/in")
    query = (
        lq.text(lq.tenant(stream, "a/x", True), "hello")
        .writeStream.format("memory").queryName("hits").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    )
    query.awaitTermination(60)
    assert spark.table("hits").count() == 1


def test_limits(spark):
    df = spark.range(600).select(F.col("id").cast("string").alias("event_id"), F.timestamp_seconds("id").alias("timestamp"))
    assert lq.newest(df, 0).count() == 0
    assert lq.newest(df, 501).count() == 501
    assert lq.newest(df, None).count() == df.count()
    assert [r[0] for r in lq.newest(df, 2).collect()] == ["599", "598"]
    with pytest.raises(ValueError):
        lq.newest(df, -1)
    assert "TakeOrderedAndProject" in plan_of(lq.newest(df, 5))
    assert lq.any_rows(df, 7).count() == 7


def test_wildcards_look_for_each_run_once(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices("abAB\\.%_(\n\u00c9\u00df\U0001d11e", k=rng.randrange(12))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame([(text,) for text in texts], "body string")
    for query in ("a%b", "%", "%%", "_", "a_b", "%a_%_B", "\\%a", ".%(_", "a%%\u00e9_", "\U0001d11e_%\u00df", "a%", "_%_%_"):
        pattern = "%" + query.replace("\\", "\\\\") + "%"
        assert sorted(map(str, lq.text(df, query).collect())) == sorted(map(str, df.where(F.col("body").ilike(pattern)).collect())), query
        assert sorted(map(str, lq.text(df, query, case=True).collect())) == sorted(map(str, df.where(F.col("body").like(pattern)).collect())), query
    long = spark.createDataFrame([("hanti ha nd " * 20_000,)], "body string")
    found = lq.text(long, "hanti%_ha%nd%never")
    assert "RLIKE" in plan_of(found)
    assert found.count() == 0
