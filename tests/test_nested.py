import json

import pytest
from pyspark.sql import functions as F

from grafloom.operators.nested import link, nested_nodes, node_table, read_record, snake, typed_nodes


@pytest.mark.parametrize("text, record", [
    ('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('Here is the record: {"a": 1} - done', {"a": 1}), (json.dumps('{"a": 1}'), {"a": 1}),
    (json.dumps(json.dumps({"a": 1})), {"a": 1}), ('[{"a": 1}]', {"a": 1}), ('{"data": {"a": 1}}', {"a": 1}), ('{"step": {"a": 1}}', {"step": {"a": 1}}), ("[draft] {\"a\": 1}", {"a": 1}),
    ("﻿ {}", {}), ('Note: "{\\"a\\": 1}"', {"a": 1}),
    ('{"a": {"b": 1}', None), ('[{"a": 1}, {"b"', None), ("text", None), ("", None), (None, None), ("3", None), ('"x"', None), ('{"a": [1, 2', None), ("[" * 100_000, None),
])
def test_payloads(text, record):
    assert read_record(text) == record


def test_one_spelling():
    assert {snake(k) for k in ("observedParameters", "observed-parameters", "Observed_Parameters", "OBSERVED_PARAMETERS", "observed parameters")} == {"observed_parameters"}


def nodes(spark, *records, **only):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "id bigint, p string")
    return nested_nodes(df, "id", "p", **only)


def test_labels(spark):
    record = {"a": [{"x": 1, "b": {"y": "t"}}, None, 5, [1]], "c": {"items": [{"z": None}]}, "s": "scalar"}
    rows = nodes(spark, record).collect()
    assert len(rows) == 8 and sorted(r["pre"] for r in rows) == list(range(8)) == sorted(r["post"] for r in rows)
    by = {(r["type"], r["pos"]): r for r in rows}
    inside = lambda a, b: a["pre"] > b["pre"] and a["post"] < b["post"]
    assert inside(by["b", 0], by["a", 0]) and not inside(by["b", 0], by["a", 2]) and all(inside(r, by["", 0]) for r in rows if r["depth"])
    assert by["b", 0]["parent_pre"] == by["a", 0]["pre"] and by["b", 0]["parent_type"] == "a"
    assert by["a", 1]["is_null"] and by["a", 2]["attributes"] == {"value": "5"} and by["element", 0]["depth"] == 2
    assert by["b", 0]["attributes"] == {"y": "t"} and by["", 0]["attributes"] == {"s": "scalar"} and by["c", 0]["attributes"] == {"z": None}


def test_link_by_containment(spark):
    record = {"steps": [{"p": [1, 2]}, {"p": [3]}, {}], "other": {"p": [4]}}
    n = nodes(spark, record, {"p": [9]})
    linked = link(n, "id", F.col("type") == "p", F.col("type") == "steps", {"pos": "step"})
    assert sorted((r["id"], r["attributes"]["value"], r["step"]) for r in linked.collect()) == [(0, "1", 0), (0, "2", 0), (0, "3", 1)]


def test_selection_and_damage(spark):
    only = nodes(spark, {"a": [{"x": 1, "y": 2}], "b": {}}, None, "broken {", types=["a"], attributes=["y"]).collect()
    assert [(r["type"], r["pre"], r["attributes"]) for r in only] == [("a", 1, {"y": "2"})]
    assert nodes(spark).count() == 0


def test_deep_and_wide(spark):
    deep = {}
    for _ in range(300):
        deep = {"n": deep}
    assert nodes(spark, deep, {"l": list(range(20_000))}).count() == 301 + 20_001


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, '{"a": {}}', "x", 7)], "pos bigint, payload string, type string, rid int")
    assert nested_nodes(df.withColumnRenamed("pos", "key"), "key", "payload").count() == 2


def test_payload_quoted_many_times():
    text = json.dumps({"a": 1})
    for _ in range(9):
        text = json.dumps(text)
    assert read_record(text) == {"a": 1} and read_record(json.dumps("x")) is None


def test_typed_records_have_the_same_nodes_as_json(spark):
    text = [
        {"a": [{"n": "x", "p": {"q": 1.5}, "l": [1, None, 3]}, None, {"n": None, "p": None, "l": None}, {"n": "y", "p": {"q": None}, "l": []}], "b": {"c": [{"d": "deep"}, {"d": None}]}, "s": ["u", None]},
        {"a": None, "b": None, "s": None}, {"a": [], "b": {"c": None}, "s": []},
    ]
    shape = "a array<struct<n:string,p:struct<q:double>,l:array<int>>>, b struct<c:array<struct<d:string>>>, s array<string>"
    df = spark.createDataFrame([(i, json.dumps(t), i) for i, t in enumerate(text)], "id int, j string, pos int").select("id", "pos", F.from_json("j", shape).alias("r")).select("id", "pos", "r.*")
    as_json = df.select("id", F.to_json(F.struct("a", "b", "s"), {"ignoreNullFields": "false"}).alias("payload"))
    rows = lambda d: sorted(map(str, (r.asDict() for r in d.collect())))
    for types in (None, ["c", "l"], ["a"]):
        assert rows(typed_nodes(df, "id", "a", "b", "s", types=types)) == rows(nested_nodes(as_json, "id", "payload", types=types))
    assert typed_nodes(df.limit(0), "id", "a").count() == 0
    table = node_table(typed_nodes(df, "id", "a", "b", "s"), "id", "a", {"n": "string"})
    assert sorted((r["id"], r["pos"], r["n"] or "") for r in table.collect()) == [(0, 0, "x"), (0, 2, ""), (0, 3, "y")]
