"""Property graphs of extractions: nodes, edges, merging, lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import MatchStrategy, match
from ..functions.text import normal
from ..session import materialize
from .assign import candidates, components

# Fixed values. Sections of an extraction in the order in which they enter the
# graph, with the label of their elements.
ENTITY_SECTIONS = [("scenes", "Scene"), ("procedures", "Procedure"), ("actors", "Actor"), ("actions", "Action"), ("tools", "Tool"), ("objects", "Object")]
# Section -> edge type, and (field, label) of source and target.
RELATION_SECTIONS = [
    ("uses_tool", "USES_TOOL", ("action", "Action"), ("tool", "Tool")), ("acts_on_object", "ACTS_ON", ("action", "Action"), ("object", "Object")),
    ("action_order", "BEFORE", ("before", "Action"), ("after", "Action")), ("action_causes", "CAUSES", ("cause", "Action"), ("effect", "Action")),
    ("part_of_procedure", "PART_OF", ("action", "Action"), ("procedure", "Procedure")), ("observed_in_scene", "OBSERVED_IN", ("action", "Action"), ("scene", "Scene")),
]
#: Mentions of a graph and label beyond which clustering is done by components.
CLUSTER_LIMIT = 2_000
_NODE = "struct<label:string,name:string,properties:map<string,string>,ord:bigint>"
_EDGE = "struct<type:string,source_label:string,source:string,target_label:string,target:string,properties:map<string,string>,ord:bigint>"


def node_id(label: Column, name: Column) -> Column:
    return F.concat(label, F.lit(":"), normal(name))


def properties(record: Column, kind: T.StructType, exclude: tuple[str, ...] = ()) -> Column:
    """The fields of a record but name and the excluded ones, as a map of
    field to JSON value (text as it is), without nulls."""
    fields = [f for f in kind.fields if f.name != "name" and f.name not in exclude]
    if not fields:
        return F.create_map().cast("map<string,string>")

    def value(f: T.StructField) -> Column:
        x = record[f.name]
        return F.to_json(x) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else x.cast("string")

    return F.map_filter(F.map_from_arrays(F.array(*(F.lit(f.name) for f in fields)), F.array(*map(value, fields))), lambda k, v: v.isNotNull())


def _element(kind: T.DataType) -> T.StructType:
    return kind.elementType


def _fields(kind: T.StructType) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in kind.fields}


def emissions(extractions: DataFrame, graph_id: str, labels: tuple[str, ...] | None = None, types: tuple[str, ...] | None = None, with_properties: bool = True) -> tuple[DataFrame, DataFrame]:
    """Every mention of a node and of an edge in the extractions, with ord, its
    place in the order of mention. Null elements and such without a name (or
    with an endpoint without one) mention nothing. Missing sections are empty.
    With labels and types only such nodes and edges are mentioned, from the
    sections that have some; without properties these are empty."""
    schema = _fields(extractions.schema)
    nodes, edges = [], []
    of_label = lambda label: labels is None or label in labels
    of_type = lambda kind: types is None or kind in types
    kept = properties if with_properties else (lambda record, kind, exclude=(): F.create_map().cast("map<string,string>"))

    def node(label: str, x: Column, kind: T.StructType, at: Column, exclude: tuple[str, ...] = ()) -> Column:
        return F.struct(F.lit(label).alias("label"), x["name"].alias("name"), kept(x, kind, exclude).alias("properties"), at.cast("bigint").alias("ord")).cast(_NODE)

    def edge(kind: str, a: tuple[str, Column], b: tuple[str, Column], props: Column, at: Column) -> Column:
        return F.struct(F.lit(kind), F.lit(a[0]), a[1], F.lit(b[0]), b[1], props, at.cast("bigint")).cast(_EDGE)

    none = F.create_map().cast("map<string,string>")
    for s, (section, label) in enumerate(ENTITY_SECTIONS):
        if section not in schema:
            continue
        kind = _element(schema[section])
        inner = _fields(kind)

        def mention(x: Column, i: Column) -> Column:
            at = F.lit(s << 40) + i.cast("bigint") * 256
            if label != "Action":
                return F.array(node(label, x, kind, at))
            out = [node(label, x, kind, at, ("actor", "scene", "parameters"))] if of_label(label) else []
            out += [node(to, x[f], inner[f], at + k) for k, (f, to) in enumerate((("actor", "Actor"), ("scene", "Scene")), 1) if f in inner and of_label(to)]
            return F.array(*out)

        def links(x: Column, i: Column) -> Column:
            at = F.lit(s << 40) + i.cast("bigint") * 256
            return F.array(*(edge(t, ("Action", x["name"]), (to, x[f]["name"]), none, at + k) for k, (t, f, to) in enumerate((("PERFORMED_BY", "actor", "Actor"), ("OBSERVED_IN", "scene", "Scene")), 1) if f in inner and of_type(t)))

        if of_label(label) or label == "Action" and any(f in inner and of_label(to) for f, to in (("actor", "Actor"), ("scene", "Scene"))):
            nodes.append(F.flatten(F.transform(F.col(section), mention)))
        if label == "Action" and any(f in inner and of_type(t) for t, f in (("PERFORMED_BY", "actor"), ("OBSERVED_IN", "scene"))):
            edges.append(F.flatten(F.transform(F.col(section), links)))
    for s, (section, kind, source, target) in enumerate(RELATION_SECTIONS, len(ENTITY_SECTIONS)):
        if section not in schema:
            continue
        shape = _element(schema[section])
        inner = _fields(shape)

        def ends(x: Column, i: Column) -> Column:
            at = F.lit(s << 40) + i.cast("bigint") * 256
            return F.array(*(node(label, x[f], inner[f], at + k) for k, (f, label) in enumerate((source, target)) if of_label(label)))

        def relation(x: Column, i: Column) -> Column:
            props = kept(x, shape, (source[0], target[0], "provenance"))
            return F.array(edge(kind, (source[1], x[source[0]]["name"]), (target[1], x[target[0]]["name"]), props, F.lit(s << 40) + i.cast("bigint") * 256 + 2))

        if of_label(source[1]) or of_label(target[1]):
            nodes.append(F.flatten(F.transform(F.col(section), ends)))
        if of_type(kind):
            edges.append(F.flatten(F.transform(F.col(section), relation)))

    def rows(parts: list[Column], shape: str) -> DataFrame:
        parts = parts or [F.lit(None)]
        together = F.flatten(F.array(*(F.coalesce(p.cast(f"array<{shape}>"), F.array().cast(f"array<{shape}>")) for p in parts)))
        return extractions.select(F.col(graph_id).alias("graph_id"), F.explode(together).alias("_m")).select("graph_id", "_m.*")

    return rows(nodes, _NODE).where("name is not null"), rows(edges, _EDGE).where("source is not null and target is not null")


def _merged_properties(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the properties, of each key of a map the last value that is
    not null."""
    entries = mentions.select(*keys, "ord", F.explode("properties").alias("k", "v")).where("v is not null")
    last = entries.groupBy(*keys, "k").agg(F.max(F.struct("ord", "v")).getField("v").alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def merge_nodes(mentions: DataFrame, *others: str) -> DataFrame:
    """One node for each graph, label and normalized name.

    The first mention gives the name, and so the id; properties are the last
    values that are not null, key by key; nested values are replaced whole.
    mentions: graph_id, label, name, properties (map), ord (unique in a graph;
    a repeated row changes nothing). Rows without a name are left out.

    returns  graph_id, node_id, label, name, properties, ord (of the first mention)
    """
    rows = mentions.where("name is not null and label is not null").withColumn("node_id", node_id(F.col("label"), F.col("name")))
    keys = ["graph_id", "node_id"]
    first = rows.groupBy(*keys).agg(F.min(F.struct("ord", "label", "name")).alias("_f")).select(*keys, "_f.label", "_f.name", "_f.ord")
    merged = first.join(_merged_properties(rows, keys), keys, "left")
    return merged.select("graph_id", "node_id", "label", "name", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), "ord")


def merge_edges(mentions: DataFrame) -> DataFrame:
    """One edge for each graph, type, source and target, numbered e1, e2, ...
    in the order of first mention; properties merge as those of nodes do.

    mentions: as from emissions(). returns  graph_id, edge_id, type, src, dst,
    properties, ord
    """
    rows = mentions.withColumns({"src": node_id(F.col("source_label"), F.col("source")), "dst": node_id(F.col("target_label"), F.col("target"))})
    keys = ["graph_id", "type", "src", "dst"]
    first = rows.groupBy(*keys).agg(F.min("ord").alias("ord"))
    merged = first.join(_merged_properties(rows, keys), keys, "left")
    number = F.row_number().over(Window.partitionBy("graph_id").orderBy("ord"))
    return merged.select("graph_id", F.concat(F.lit("e"), number).alias("edge_id"), "type", "src", "dst", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), "ord")


def build_property_graph(extractions: DataFrame, graph_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all extractions, one graph for each row."""
    nodes, edges = emissions(extractions, graph_id)
    return merge_nodes(nodes), merge_edges(edges)


def part_of_graph(extractions: DataFrame, graph_id: str, labels: tuple[str, ...], types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node_id, label, name, ord) of these labels and edges
    (graph_id, type, src, dst, ord) of these types, as in the whole graph, but
    from the sections that mention them alone, and without properties. Edges
    have no number here, since that counts all edges."""
    nodes, edges = emissions(extractions, graph_id, labels, types, with_properties=False)
    keys = ["graph_id", "node_id"]
    nodes = nodes.withColumn("node_id", node_id(F.col("label"), F.col("name"))).groupBy(*keys).agg(F.min(F.struct("ord", "label", "name")).alias("_f")).select(*keys, "_f.label", "_f.name", "_f.ord")
    edges = edges.withColumns({"src": node_id(F.col("source_label"), F.col("source")), "dst": node_id(F.col("target_label"), F.col("target"))})
    return nodes, edges.groupBy("graph_id", "type", "src", "dst").agg(F.min("ord").alias("ord"))


def nodes_by_id(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The node of each asked (graph_id, node_id), in all its columns, with
    found; an id that no node has gives a row of nulls with found false."""
    ids = asked.select("graph_id", "node_id").distinct()
    return ids.join(nodes.withColumn("found", F.lit(True)), ["graph_id", "node_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def exact_node_ids(mentions: DataFrame) -> DataFrame:
    """Nodes that are told apart by their exact name: equal normalized names
    get the suffixes :2, :3, ... in the order of first mention."""
    rows = mentions.where("name is not null").groupBy("graph_id", "label", "name").agg(F.min("ord").alias("ord"))
    base = node_id(F.col("label"), F.col("name"))
    nth = F.row_number().over(Window.partitionBy("graph_id", base).orderBy("ord"))
    return rows.select("graph_id", F.when(nth == 1, base).otherwise(F.concat(base, F.lit(":"), nth)).alias("node_id"), "label", "name", "ord")


def cluster_nodes(mentions: DataFrame, strategy: MatchStrategy | str, threshold: float = 0.85, *, fold_limit: int = CLUSTER_LIMIT) -> DataFrame:
    """Mentions with the ord of the node they join (node_ord), where names
    match by a strategy that is no equivalence, as token overlap: each mention,
    in order, joins the best node made so far (ties: the oldest) that scores at
    least threshold, or makes a new one.

    The order decides, so that mentions are passed one after another; graphs and
    labels are independent. By token overlap, more than fold_limit mentions of a
    graph and label fall into components first, of mentions that may join each
    other directly or over others, which are independent too; the result is the
    same.
    """
    keys = ["graph_id", "label"]
    rows = mentions.where("name is not null").select(*keys, "name", "ord").distinct()
    if strategy != MatchStrategy.TOKEN_OVERLAP or threshold <= 0:
        return _fold_clusters(rows, keys, strategy, threshold)
    rows = materialize(rows)
    large = materialize(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > fold_limit).select(*keys))
    if large.isEmpty():
        return _fold_clusters(rows, keys, strategy, threshold)
    those = rows.join(large, keys, "left_semi").withColumn("_g", F.struct(*keys))
    # Names without a token join each other alone.
    worded = those.where(normal(F.col("name")) != "")
    pairs = candidates(worded, worded, "_g", "name", "ord", strategy, least=threshold).where("x <= e")
    parts = components(pairs, "_g").select("_g", F.col("e").alias("ord"), "comp")
    parted = those.join(parts, ["_g", "ord"], "left").withColumn("comp", F.coalesce(F.col("comp").cast("string"), F.lit("none"))).drop("_g")
    return _fold_clusters(rows.join(large, keys, "left_anti"), keys, strategy, threshold).unionByName(_fold_clusters(parted, [*keys, "comp"], strategy, threshold))


def _fold_clusters(rows: DataFrame, keys: list[str], strategy: MatchStrategy | str, threshold: float) -> DataFrame:
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("ms"))
    start = F.struct(F.array().cast("array<struct<ord:bigint,name:string>>").alias("made"), F.array().cast("array<struct<ord:bigint,name:string,node_ord:bigint>>").alias("log"))

    def step(acc, m):
        scored = F.transform(acc["made"], lambda n: F.struct((-match(strategy, m["name"], n["name"])).alias("ns"), n["ord"].alias("ord")))
        best = F.get(F.array_sort(F.filter(scored, lambda s: -s["ns"] >= threshold)), F.lit(0))
        joins = best.isNotNull()
        return F.struct(
            F.when(joins, acc["made"]).otherwise(F.concat(acc["made"], F.array(F.struct(m["ord"].alias("ord"), m["name"].alias("name"))))).alias("made"),
            F.concat(acc["log"], F.array(F.struct(m["ord"].alias("ord"), m["name"].alias("name"), F.coalesce(best["ord"], m["ord"]).alias("node_ord")))).alias("log"),
        )

    return lists.select("graph_id", "label", F.explode(F.aggregate("ms", start, step, lambda acc: acc["log"])).alias("_l")).select("graph_id", "label", "_l.*")


def merge_clusters(mentions: DataFrame, strategy: MatchStrategy | str, threshold: float = 0.85) -> DataFrame:
    """Nodes of mentions that are merged by a strategy that is no equivalence
    (see cluster_nodes): the first mention gives name and id, equal ids of a
    graph get the suffixes :2, :3, ... in that order; properties are the last
    values that are not null, key by key.

    returns  graph_id, node_id, label, name, properties, ord (of the first mention)
    """
    once = mentions.where("name is not null").dropDuplicates(["graph_id", "ord"])
    joined = once.join(cluster_nodes(once, strategy, threshold).select("graph_id", "ord", "node_ord"), ["graph_id", "ord"])
    keys = ["graph_id", "node_ord"]
    first = joined.where("ord = node_ord").select(*keys, "label", "name")
    base = node_id(F.col("label"), F.col("name"))
    nth = F.row_number().over(Window.partitionBy("graph_id", base).orderBy("node_ord"))
    merged = first.withColumn("node_id", F.when(nth == 1, base).otherwise(F.concat(base, F.lit(":"), nth))).join(_merged_properties(joined, keys), keys, "left")
    return merged.select("graph_id", "node_id", "label", "name", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"), F.col("node_ord").alias("ord"))


def find_nodes(nodes: DataFrame, lookups: DataFrame, label: str, strategy: MatchStrategy | str = MatchStrategy.NORMALIZED, threshold: float = 0.85) -> DataFrame:
    """For each lookup (graph_id, query) the node of the label with the best
    score of query against its name (ties: the first mentioned), if that is at
    least threshold: graph_id, query, node_id, score.

    Nodes are met through the normalized name or the rarest tokens (see
    candidates), not one by one. A lookup of null finds nothing.
    """
    queries = lookups.select("graph_id", F.col("query").alias("pos"), F.col("query").alias("name")).where("name is not null").distinct()
    pool = nodes.where((F.col("label") == label) & F.col("name").isNotNull()).select("graph_id", F.struct("ord", "node_id").alias("pos"), "name")
    scored = candidates(queries, pool, "graph_id", "name", strategy=strategy, least=threshold)
    best = scored.groupBy("graph_id", "e").agg(F.min(F.struct((-F.col("score")).alias("ns"), "x")).alias("_b"))
    return best.select("graph_id", F.col("e").alias("query"), "_b.x.node_id", (-F.col("_b.ns")).alias("score"))


def outgoing(edges: DataFrame, at: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges whose source is among the nodes (graph_id, node_id) of at; order
    by ord gives the order of mention."""
    rows = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    return rows.join(at.select("graph_id", F.col("node_id").alias("src")).distinct(), ["graph_id", "src"], "left_semi")


def incoming(edges: DataFrame, at: DataFrame, edge_type: str | None = None) -> DataFrame:
    rows = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    return rows.join(at.select("graph_id", F.col("node_id").alias("dst")).distinct(), ["graph_id", "dst"], "left_semi")


def _neighbours(nodes: DataFrame, edges: DataFrame, lookups: DataFrame, label: str, edge_type: str, forward: bool) -> DataFrame:
    here, there = ("src", "dst") if forward else ("dst", "src")
    found = find_nodes(nodes, lookups, label, MatchStrategy.TOKEN_OVERLAP, 0.6).select("graph_id", "query", F.col("node_id").alias(here))
    steps = edges.where(F.col("type") == edge_type).select("graph_id", "src", "dst", "ord").join(found, ["graph_id", here])
    return steps.select("graph_id", "query", F.col(there).alias("node_id"), "ord").join(nodes.select("graph_id", "node_id", "name"), ["graph_id", "node_id"])


def tools_for_action(nodes: DataFrame, edges: DataFrame, lookups: DataFrame) -> DataFrame:
    """graph_id, query, node_id, name, ord of the tools that the action meant
    by each lookup uses; none where no action is meant."""
    return _neighbours(nodes, edges, lookups, "Action", "USES_TOOL", True)


def actions_using_tool(nodes: DataFrame, edges: DataFrame, lookups: DataFrame) -> DataFrame:
    return _neighbours(nodes, edges, lookups, "Tool", "USES_TOOL", False)


def effects_caused_by(nodes: DataFrame, edges: DataFrame, lookups: DataFrame) -> DataFrame:
    """The direct effects of the action meant by each lookup."""
    return _neighbours(nodes, edges, lookups, "Action", "CAUSES", True)


def ordered_actions(nodes: DataFrame) -> DataFrame:
    """Actions with their place in their graph: by sequence_index, actions
    without one last, ties in order of mention."""
    index = F.coalesce(F.try_element_at("properties", F.lit("sequence_index")).cast("bigint"), F.lit(1_000_000_000))
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(index, "ord"))
    return nodes.where("label = 'Action'").select("graph_id", "node_id", "name", place.alias("place"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
