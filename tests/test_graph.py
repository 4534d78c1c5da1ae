import json

import pytest
from pyspark.sql import functions as F

from grafloom.functions.matching import MatchStrategy
from grafloom.operators.graph import (  # noqa: I001
    actions_using_tool, build_property_graph, cluster_nodes, effects_caused_by, exact_node_ids, find_nodes, incoming, merge_clusters, merge_nodes, nodes_by_id, ordered_actions, outgoing, part_of_graph, tools_for_action,
)
from grafloom.schema import struct_type


def named(*names):
    return [{"name": n} for n in names]


def action(name, index, actor, role, **more):
    return {"name": name, "sequence_index": index, "actor": {"name": actor, "role": role}, **more}


# Two gold scenes.
WELDING = {
    "video_id": "weld_demo_01",
    "scenes": [{"name": "weld_demo_01 segment s1", "segment_id": "s1", "timestamp_start_seconds": 0.0, "timestamp_end_seconds": 20.0}],
    "procedures": [{"name": "Root welding preparation", "domain": "welding"}],
    "actors": [{"name": "Hans", "role": "operator"}],
    "actions": [
        action("pick up welding torch", 1, "Hans", "operator", provenance={"video_id": "weld_demo_01", "segment_id": "s1", "confidence": 0.95}),
        action("align steel plate", 2, "Hans", "operator"), action("start root weld", 3, "Hans", "operator"),
    ],
    "tools": [{"name": "Fronius TPS 400i torch", "tool_type": "welding torch", "manufacturer": "Fronius", "model": "TPS 400i"}],
    "objects": [{"name": "steel plate", "object_type": "workpiece", "state": "unaligned"}],
    "uses_tool": [{"action": a, "tool": {"name": "Fronius TPS 400i torch"}, "confidence": 0.9} for a in named("pick up welding torch", "start root weld")],
    "acts_on_object": [{"action": {"name": "align steel plate"}, "object": {"name": "steel plate"}, "role": "target"}],
    "action_order": [{"before": {"name": a}, "after": {"name": b}} for a, b in (("pick up welding torch", "align steel plate"), ("align steel plate", "start root weld"))],
    "action_causes": [{"cause": {"name": "align steel plate"}, "effect": {"name": "start root weld"}, "rationale": "The alignment step prepares the plate for the root weld."}],
    "part_of_procedure": [{"action": a, "procedure": {"name": "Root welding preparation"}} for a in named("align steel plate", "start root weld")],
    "observed_in_scene": [{"action": a, "scene": {"name": "weld_demo_01 segment s1"}} for a in named("pick up welding torch", "align steel plate", "start root weld")],
}
INSPECTION = {
    "video_id": "inspect_demo_01",
    "scenes": [{"name": "inspect_demo_01 segment s2"}], "procedures": [], "actors": [{"name": "Maria", "role": "quality_inspector"}],
    "actions": [action(n, i, "Maria", "quality_inspector") for i, n in enumerate(("place caliper on bracket", "measure gap", "record result"), 1)],
    "tools": [{"name": "caliper", "tool_type": "measurement tool"}], "objects": [{"name": "bracket", "object_type": "workpiece"}, {"name": "gap", "object_type": "measurement target"}],
    "uses_tool": [{"action": {"name": "measure gap"}, "tool": {"name": "caliper"}}],
    "acts_on_object": [{"action": {"name": a}, "object": {"name": o}, "role": "target"} for a, o in (("place caliper on bracket", "bracket"), ("measure gap", "gap"))],
    "action_order": [{"before": {"name": a}, "after": {"name": b}} for a, b in (("place caliper on bracket", "measure gap"), ("measure gap", "record result"))],
    "action_causes": [{"cause": {"name": "measure gap"}, "effect": {"name": "record result"}}], "part_of_procedure": [], "observed_in_scene": [],
}


@pytest.fixture(scope="module")
def gold(spark):
    extra = json.loads(json.dumps(WELDING))
    extra["tools"].append({"name": "fronius   tps 400i torch"})
    rows = [(i, json.dumps(r)) for i, r in enumerate((WELDING, INSPECTION, extra, {"scenes": None, "actions": [None, {"name": None}]}), 1)]
    df = spark.createDataFrame(rows, "graph_id bigint, j string").select("graph_id", F.from_json("j", struct_type("EgocentricVideoExtraction")).alias("r")).select("graph_id", "r.*")
    nodes, edges = build_property_graph(df, "graph_id")
    return nodes.cache(), edges.cache()


def ask(spark, graph, text):
    return spark.createDataFrame([(graph, text)], "graph_id bigint, query string")


def names(df):
    return [r["name"] for r in df.orderBy("ord").collect()]


def test_sizes(gold):
    nodes, edges = gold
    assert {r["graph_id"]: r["count"] for r in nodes.groupBy("graph_id").count().collect()} == {1: 8, 2: 8, 3: 8}
    kinds = {(r["graph_id"], r["type"]): r["count"] for r in edges.groupBy("graph_id", "type").count().collect()}
    assert {t: n for (g, t), n in kinds.items() if g == 1} == {"PERFORMED_BY": 3, "USES_TOOL": 2, "ACTS_ON": 1, "BEFORE": 2, "CAUSES": 1, "PART_OF": 2, "OBSERVED_IN": 3}
    assert sum(n for (g, _), n in kinds.items() if g == 2) == 9
    assert [r["type"] for r in edges.where("graph_id = 1 and edge_id in ('e1', 'e4', 'e9', 'e14')").orderBy("ord").collect()] == ["PERFORMED_BY", "USES_TOOL", "CAUSES", "OBSERVED_IN"]


def test_questions(spark, gold):
    assert names(tools_for_action(*gold, ask(spark, 1, "start root weld"))) == ["Fronius TPS 400i torch"]
    assert set(names(actions_using_tool(*gold, ask(spark, 1, "TPS 400i")))) == {"pick up welding torch", "start root weld"}
    assert names(effects_caused_by(*gold, ask(spark, 1, "align plate"))) == ["start root weld"]
    assert names(tools_for_action(*gold, ask(spark, 2, "measure gap"))) == ["caliper"]
    assert names(effects_caused_by(*gold, ask(spark, 2, "measure gap"))) == ["record result"]
    assert names(tools_for_action(*gold, ask(spark, 1, "no such thing"))) == []
    placed = ordered_actions(gold[0]).where("graph_id = 2").orderBy("place")
    assert [r["name"] for r in placed.collect()] == ["place caliper on bracket", "measure gap", "record result"]


def test_properties(gold):
    nodes, edges = gold
    tool = nodes.where("graph_id = 3 and label = 'Tool'").collect()
    assert len(tool) == 1 and tool[0]["properties"]["tool_type"] == "welding torch" and tool[0]["name"] == "Fronius TPS 400i torch"
    seen = nodes.where("graph_id = 1 and name = 'pick up welding torch'").first()["properties"]
    assert json.loads(seen["provenance"])["video_id"] == "weld_demo_01" and "actor" not in seen
    cause = edges.where("graph_id = 1 and type = 'CAUSES'").first()["properties"]
    assert cause == {"rationale": "The alignment step prepares the plate for the root weld."}


def test_lookup_direction(spark, gold):
    nodes, edges = gold
    found = lambda q, s, t: [r["node_id"] for r in find_nodes(nodes, ask(spark, 1, q), "Tool", s, t).collect()]
    assert found("TPS 400i", MatchStrategy.TOKEN_OVERLAP, 0.6) == ["Tool:fronius tps 400i torch"]
    assert found("Fronius TPS 400i torch with cable and more words", MatchStrategy.TOKEN_OVERLAP, 0.6) == []
    assert found("FRONIUS  tps 400i torch", MatchStrategy.NORMALIZED, 0.85) == ["Tool:fronius tps 400i torch"]
    assert outgoing(edges, nodes.where("graph_id = 1 and name = 'align steel plate'")).count() == 6
    assert incoming(edges, nodes.where("graph_id = 1 and label = 'Actor'")).count() == 3


def test_merge_keeps_first_name_and_last_values(spark):
    rows = [(1, "Tool", "A b", {"x": "1", "y": "2"}, 1), (1, "Tool", " a  B", {"x": None, "y": "3", "z": "4"}, 2), (1, "Tool", None, {"x": "9"}, 3), (1, "Tool", "A b", {"x": "1", "y": "2"}, 1)]
    df = spark.createDataFrame(rows, "graph_id bigint, label string, name string, properties map<string,string>, ord bigint")
    assert [(r["name"], r["properties"]) for r in merge_nodes(df).collect()] == [("A b", {"x": "1", "y": "3", "z": "4"})]
    assert merge_nodes(df.limit(0)).count() == 0


def test_exact_ids_get_suffixes(spark):
    df = spark.createDataFrame([(1, "Tool", n, i) for i, n in enumerate(["A", "a", "A", "A ", "b"])], "graph_id bigint, label string, name string, ord bigint")
    assert {r["name"]: r["node_id"] for r in exact_node_ids(df).collect()} == {"A": "Tool:a", "a": "Tool:a:2", "A ": "Tool:a:3", "b": "Tool:b"}


def test_clustering_depends_on_order(spark):
    df = spark.createDataFrame([(1, "T", n, i) for i, n in enumerate(["a b c", "a b", "c d", "a", "d x"])], "graph_id bigint, label string, name string, ord bigint")
    got = {r["ord"]: r["node_ord"] for r in cluster_nodes(df, MatchStrategy.TOKEN_OVERLAP, 0.6).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_clusters_of_components_are_those_of_the_whole(spark):
    import random

    rng = random.Random(4)
    rows = [(g, "T", " ".join(rng.choices("a b c d e f".split(), k=rng.randint(0, 4))), i) for g in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "graph_id bigint, label string, name string, ord bigint")
    for threshold in (0.5, 0.85):
        whole, parts = (sorted(map(tuple, cluster_nodes(df, MatchStrategy.TOKEN_OVERLAP, threshold, fold_limit=n).collect())) for n in (10**9, 0))
        assert whole == parts and len({r[4] for r in whole}) > 3


def test_clusters_are_merged(spark):
    rows = [(1, "T", "a b c", {"x": "1"}, 0), (1, "T", "a b", {"x": "2", "y": None}, 1), (1, "T", "c d", {"x": "3"}, 2), (1, "T", "A  b c", {"y": "4"}, 3), (1, "T", "zz", None, 4), (1, "T", None, {"x": "9"}, 5), (1, "T", "a b", {"x": "2"}, 1)]
    df = spark.createDataFrame(rows, "graph_id bigint, label string, name string, properties map<string,string>, ord bigint")
    got = {r["node_id"]: (r["name"], r["properties"], r["ord"]) for r in merge_clusters(df, MatchStrategy.TOKEN_OVERLAP, 0.6).collect()}
    assert got == {"T:a b c": ("a b c", {"x": "2", "y": "4"}, 0), "T:c d": ("c d", {"x": "3"}, 2), "T:zz": ("zz", {}, 4)}
    apart = {r["node_id"] for r in merge_clusters(df, MatchStrategy.EXACT, 0.6).collect()}
    assert apart == {"T:a b c", "T:a b", "T:c d", "T:a b c:2", "T:zz"}


def test_nodes_by_id(spark, gold):
    asked = spark.createDataFrame([(1, "Tool:fronius tps 400i torch"), (1, "Tool:none"), (9, "Tool:x")], "graph_id bigint, node_id string")
    assert {(r["graph_id"], r["name"], r["found"]) for r in nodes_by_id(gold[0], asked).collect()} == {(1, "Fronius TPS 400i torch", True), (1, None, False), (9, None, False)}


def test_part_of_a_graph_is_as_in_the_whole(spark, gold):
    rows = [(i, json.dumps(r)) for i, r in enumerate((WELDING, INSPECTION), 1)]
    df = spark.createDataFrame(rows, "graph_id bigint, j string").select("graph_id", F.from_json("j", struct_type("EgocentricVideoExtraction")).alias("r")).select("graph_id", "r.*")
    nodes, edges = gold
    for labels, types in ((("Action", "Tool"), ("USES_TOOL",)), (("Actor",), ("PERFORMED_BY", "BEFORE")), ((), ())):
        n, e = part_of_graph(df, "graph_id", labels, types)
        own = ["graph_id", "node_id", "label", "name", "ord"]
        assert sorted(map(tuple, n.select(own).collect())) == sorted(map(tuple, nodes.where(F.col("graph_id") < 3).where(F.col("label").isin(list(labels))).select(own).collect()))
        assert sorted(map(tuple, e.collect())) == sorted(map(tuple, edges.where(F.col("graph_id") < 3).where(F.col("type").isin(list(types))).select(e.columns).collect()))
