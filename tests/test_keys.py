from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import logquarry as lq
from logquarry.operators.projections import file_rows


def parse(spark, *keys):
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    return {r["key"]: r.asDict() for r in file_rows(lq.with_key_meta(df)).collect()}


@pytest.mark.parametrize(
    "key, trace",
    [
        ("p/s_t_chat_h_20250614T051500Z_id.jsonl", "t"),
        ("p/s_t_w_u_chat_h_20250614T051500Z_id.jsonl", "t_w_u"),
        ("p/s_t_chat_h_20250614T051500Z_id.json.jsonl", "t"),
        ("p/s_t_chat_h_20250614T051500Z_id.json", "t"),
        ("p/s_t_chat_h_20250614T051500Z_id", "t"),
        ("s_chat_h_20250614T051500Z_id.jsonl", "unknown"),
        ("p/s__chat_h_20250614T051500Z_id.jsonl", ""),
        ("p/s____chat_h_20250614T051500Z_id.jsonl", "__"),
    ],
)
def test_fields(spark, key, trace):
    row = parse(spark, key)[key]
    assert (row["session_id"], row["trace_type"], row["input_hash"]) == ("s", "chat", "h")
    assert row["trace_id"] == trace
    assert row["timestamp"] == "2025-06-14T05:15:00+00:00"


def test_underscore_in_type_shifts_fields(spark):
    row = parse(spark, "p/s_t_my_type_h_20250614T051500Z_id.jsonl")["p/s_t_my_type_h_20250614T051500Z_id.jsonl"]
    assert (row["trace_id"], row["trace_type"]) == ("t_my", "type")


@pytest.mark.parametrize(
    "key",
    [
        "p/noparts.jsonl",
        "",
        "p/media/m.meta.json",
        "p/s_t_chat_h_20261301T120000Z_id.jsonl",
        "p/s_t_chat_h_20260230T120000Z_id.jsonl",
        "p/s_t_chat_h_00000101T120000Z_id.jsonl",
        "p/s_t_chat_h_20250614t051500z_id.jsonl",
        "p/chat_h_20250614T051500Z_id.jsonl",
        "s_t/chat_h_20250614T051500Z_id.jsonl",
        "2026-03-01T12:00:00Z",
        "p/s_t_chat_h_20250614T051500Z_id/",
    ],
)
def test_unusable_keys_are_dropped(spark, key):
    assert parse(spark, key) == {}


def test_session_time_zone_does_not_matter(spark):
    key = "p/s_t_chat_h_20240310T023000Z_id.jsonl"
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert parse(spark, key)[key]["timestamp"] == "2024-03-10T02:30:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


part = st.text("abcXYZ019-.", min_size=1, max_size=8)


@settings(max_examples=5, deadline=None)
@given(
    st.lists(
        st.tuples(part, st.lists(part, max_size=3), part, part, st.datetimes(datetime(1970, 1, 1), datetime(2100, 1, 1)), part),
        min_size=1,
        max_size=30,
        unique_by=lambda row: row[5],
    )
)
def test_built_keys_read_back(spark, rows):
    expected = {}
    for session, trace, kind, digest, ts, unique in rows:
        name = "_".join([session, *trace, kind, digest, ts.strftime("%Y%m%dT%H%M%SZ"), unique])
        expected[f"a/b/{name}.jsonl"] = (session, "_".join(trace) if trace else "unknown", kind, digest,
                                         ts.strftime("%Y-%m-%dT%H:%M:%S+00:00"))
    found = parse(spark, *expected)
    fields = ("session_id", "trace_id", "trace_type", "input_hash", "timestamp")
    assert {k: tuple(row[f] for f in fields) for k, row in found.items()} == expected


def test_iso_text(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP'2026-03-01 12:00:00+05:00'), (TIMESTAMP'1969-12-31 23:59:59.000070Z') AS t(ts)"
    )
    assert [r[0] for r in rows.select(lq.iso_utc(F.col("ts"))).collect()] == [
        "2026-03-01T07:00:00+00:00",
        "1969-12-31T23:59:59.000070+00:00",
    ]


@pytest.mark.parametrize(
    "raw, clean",
    [("  ../../etc/pw  ", "etc/pw"), ("acme//al ice/", "acme/al_ice"), ("a...b", "a.b"), ("x\ny", "x_y"), ("😀a", "a")],
)
def test_tenant_cleanup(spark, raw, clean):
    assert lq.clean_tenant(spark, raw) == clean


@pytest.mark.parametrize("raw", ["..", "", " /._- "])
def test_empty_tenant_is_an_error(spark, raw):
    with pytest.raises(ValueError):
        lq.clean_tenant(spark, raw)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("http://in/b/http://in/k", "https://out/b/http://in/k"),
        ("http://in", "https://out"),
        ("s3://other", "s3://other"),
    ],
)
def test_only_the_first_base_is_rewritten(spark, text, expected):
    row = spark.createDataFrame([(text,)], "u string").select(lq.rewrite_base(F.col("u"), "http://in", "https://out"))
    assert row.head()[0] == expected
