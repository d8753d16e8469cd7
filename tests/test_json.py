import json

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

import logquarry as lq
from logquarry.functions.jsonvals import with_variant

DUPLICATES = "spark.sql.variant.allowDuplicateKeys"


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, body string")


@pytest.mark.parametrize(
    "text",
    ['{"a": 1}', "[1]", '"s"', "null", " 5 ", '{"a":1,"a":2}', '{"a":"x\\"]"}', None, "", "{bad", '{"a":1} x', "1,2",
     '{"a":1}}', "1],[2", "{'a':1}", "01", '{"a":1},"x":2', "[1]]", "[", '"', '{"a"}'],
)
def test_body_fallback_agrees_with_a_json_parser(spark, text):
    try:
        json.loads(text)
        expected = text
    except (TypeError, ValueError):
        expected = "{}"
    assert bodies(spark, text).select(lq.body_or_empty(F.col("body"))).head()[0] == expected
    parsed = with_variant(bodies(spark, text), "v", F.col("body")).select(F.col("v").isNotNull())
    if '"a":1,"a"' in (text or ""):  # never lost without a word
        with pytest.raises(SparkRuntimeException, match="repeats a key"):
            parsed.head()
    else:
        assert parsed.head()[0] == (expected == text)


def test_duplicate_keys_take_the_last_value_when_allowed(spark):
    spark.conf.set(DUPLICATES, "true")
    try:
        row = with_variant(bodies(spark, '{"a":1,"a":2}'), "v", F.col("body")).select(F.to_json("v")).head()
    finally:
        spark.conf.unset(DUPLICATES)
    assert row[0] == '{"a":2}'


def shown(spark, body):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    row = lq.preview(bodies(spark, text)).head()
    return row["model"], row["input_preview"], row["output_preview"]


LONG = "x" * 100


@pytest.mark.parametrize(
    "body, expected",
    [
        (None, ("-", "-", "-")),
        ("{bad", ("-", "-", "-")),
        ({}, ("-", "-", "-")),
        ("[1]", ("-", "-", "-")),
        ({"model": "m", "input": LONG, "output": LONG}, ("m", "x" * 80, "x" * 80)),
        ({"model": "", "input": "", "output": 0}, ("-", "-", "-")),
        ({"input": 0, "output": False}, ("-", "-", "-")),
        ({"input": "0", "output": "0"}, ("-", "0", "-")),
        ({"input": 5, "output": 5}, ("-", "5", "-")),
        ({"input": [{"content": "a"}, {"content": "b"}]}, ("-", "b", "-")),
        ({"input": {"messages": [{"content": [{"text": "p"}, {"content": "q"}, {"z": 1, "a": 2}, "s"]}]}},
         ("-", 'p q {"z":1,"a":2} "s"', "-")),
        ({"input": {"messages": [{"role": "user"}]}}, ("-", "", "-")),
        ({"input": {"messages": [{"content": {"z": 1, "a": 2}}]}}, ("-", '{"z":1,"a":2}', "-")),
        ({"input": {"messages": []}}, ("-", '{"messages":[]}', "-")),
        ({"input": []}, ("-", "[]", "-")),
        ({"input": {"z": [1, 2], "a": "é"}}, ("-", '{"z":[1,2],"a":"é"}', "-")),
        ({"input": json.dumps({"messages": [{"content": "deep"}]})}, ("-", "deep", "-")),
        ({"input": json.dumps("quoted"), "output": json.dumps({"content": "c"})}, ("-", "quoted", "c")),
        ({"output": {"choices": [{"message": {"content": "one"}}, {"message": {"content": "two"}}]}}, ("-", "-", "one")),
        ({"output": {"choices": [{"message": None}], "content": "c"}}, ("-", "-", "-")),
        ({"output": {"choices": [], "content": "c"}}, ("-", "-", "c")),
        ({"output": {"content": [{"text": "t"}]}}, ("-", "-", "t")),
        ({"output": {"other": 1}}, ("-", "-", "-")),
        ({"output": "plain text"}, ("-", "-", "plain text")),
        (json.dumps(json.dumps({"model": "m", "input": "i"})), ("m", "i", "-")),
    ],
)
def test_preview(spark, body, expected):
    assert shown(spark, body) == expected


def conversation(spark, body):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    rows = lq.to_messages(bodies(spark, text)).select(F.to_json("messages")).collect()
    return json.loads(rows[0][0]) if rows else None


def m(role, content):
    return {"role": role, "content": content}


@pytest.mark.parametrize(
    "body, expected",
    [
        ({"input": {"messages": [m("system", "s"), m("user", "u")]}}, [m("system", "s"), m("user", "u")]),
        ({"input": [m("user", "u")], "output": {"choices": [{"message": m("assistant", "a")}]}},
         [m("user", "u"), m("assistant", "a")]),
        ({"input": [m("user", "u")], "output": m("assistant", "a") | {"choices": []}}, [m("user", "u"), m("assistant", "a")]),
        ({"input": [m("user", "u")], "output": m("assistant", "a") | {"choices": [{"message": m("assistant", "")}]}}, None),
        ({"input": [m("user", "u"), m("user", ""), m("", "x"), None, {"role": "user"}, m("user", 0)]}, None),
        ({"input": [m("user", "u"), m("user", []), m("tool", {"b": 1})]}, [m("user", "u"), m("user", []), m("tool", {"b": 1})]),
        ({"input": [m("user", [{"type": "text", "text": "t"}]), m("x", "y") | {"extra": 1}]},
         [m("user", [{"type": "text", "text": "t"}]), m("x", "y")]),
        ({"input": json.dumps([m("user", "u"), m("user", "v")])}, None),
        (json.dumps(json.dumps({"input": [m("user", "u"), m("user", "v")]})), None),
        ({"input": {"messages": "x"}, "output": None}, None),
        (None, None),
        ("{bad", None),
        ("[1]", None),
    ],
)
def test_conversations(spark, body, expected):
    assert conversation(spark, body) == expected


def test_every_body_is_parsed_once_and_no_python_runs(spark):
    from conftest import plan_of

    rows = bodies(spark, '{"input":[]}').repartition(2)
    plan = plan_of(lq.to_messages(rows))
    assert plan.count("VariantExpressionEvalUtils.parseJson") == 1
    assert "Python" not in plan + plan_of(lq.preview(rows))
