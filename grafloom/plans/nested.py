"""Flat tables of nested extractions and execution payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normal
from ..operators.nested import link, nested_nodes, node_table, typed_nodes
from ..session import materialize
from ..sources.tables import table

#: The lists of an extraction.
LISTS = [
    "procedures", "scenes", "actors", "actions", "tools", "objects", "parameters", "uses_tool", "acts_on_object", "action_order", "action_causes",
    "part_of_procedure", "observed_in_scene",
]


def video_nodes(spark: SparkSession, d: str, **only) -> DataFrame:
    """Nodes of the extractions, each delivered record once."""
    rows = table(spark, d, "video_extractions").select("extraction_id", *LISTS).dropDuplicates(["extraction_id"])
    return typed_nodes(rows, "extraction_id", *LISTS, **only)


def execution_nodes(spark: SparkSession, d: str, **only) -> DataFrame:
    rows = table(spark, d, "execution_records").select("record_id", "payload")
    return nested_nodes(rows.dropDuplicates(["record_id"]), "record_id", "payload", **only)


def _named_place(elements: DataFrame, references: DataFrame, lists: str, parent: str, child: str) -> DataFrame:
    """Place of what each element of list child names by its reference node:
    the first element of the list parent with the same name, else -1."""
    name = normal(F.col("attributes")["name"])
    places = elements.where((F.col("type") == parent) & (F.col("depth") == 1)).select("extraction_id", name.alias("name"), "pos").where("name <> ''")
    places = places.groupBy("extraction_id", "name").agg(F.min("pos").alias("parent_pos"))
    named = references.select("extraction_id", "owner_pos", name.alias("name"))
    found = named.join(places, ["extraction_id", "name"]).select("extraction_id", F.col("owner_pos").alias("pos"), "parent_pos")
    children = elements.where((F.col("type") == child) & (F.col("depth") == 1) & ~F.col("is_null")).select("extraction_id", "pos")
    return children.join(found, ["extraction_id", "pos"], "left").select(
        F.lit(child).alias("child"), F.col("extraction_id").alias("parent_id"), F.coalesce("parent_pos", F.lit(-1)).alias("parent_pos"), "pos"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # Both node tables are read several times below: parse the records once.
    nodes = materialize(video_nodes(spark, d, types=["scenes", "actions", "scene", "uses_tool", "action"], attributes=["name"]))
    kind, depth = F.col("type"), F.col("depth")
    scene_of = link(nodes, "extraction_id", (kind == "scene") & (depth == 2), (kind == "actions") & (depth == 1), {"pos": "owner_pos"})
    action_of = link(nodes, "extraction_id", (kind == "action") & (depth == 2), (kind == "uses_tool") & (depth == 1), {"pos": "owner_pos"})
    observed = "observed_parameters"
    steps = materialize(execution_nodes(spark, d, types=["", "step_executions", "procedure", observed], attributes=["step_number"]))
    roots = steps.where("type in ('procedure', 'step_executions') and depth = 1").select("record_id").distinct()
    types = table(spark, d, "execution_records").select("record_id", "record_type").where("record_type is not null").dropDuplicates(["record_id"])
    # The record itself is the step execution, or its step_executions are; the type decides, where it is missing the shape.
    single = (
        steps.where("depth = 0").select("record_id").join(types, "record_id", "left").join(roots.withColumn("many", F.lit(True)), "record_id", "left")
        .where(F.coalesce(F.col("record_type") == "StepExecution", F.col("many").isNull())).select("record_id")
    )
    is_child = kind == observed
    in_steps = link(steps, "record_id", is_child & (depth == 2) & ~F.col("is_null"), (kind == "step_executions") & (depth == 1), {"pos": "parent_pos"})
    in_record = steps.where(is_child & (depth == 1) & ~F.col("is_null")).join(single, "record_id", "left_semi").withColumn("parent_pos", F.lit(0))
    return (
        _named_place(nodes, scene_of, "scenes", "scenes", "actions")
        .unionByName(_named_place(nodes, action_of, "actions", "actions", "uses_tool"))
        .unionByName(in_steps.unionByName(in_record).select(F.lit(observed).alias("child"), F.col("record_id").alias("parent_id"), "parent_pos", "pos"))
    )


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of both sources with its labels and its parent's label."""
    columns = ["type", "pos", "pre", "post", "depth", "parent_pre", "parent_type", "is_null", F.size("attributes").alias("n_attributes")]
    return (
        video_nodes(spark, d).select(F.lit("video_extractions").alias("origin"), F.col("extraction_id").alias("record_id"), *columns)
        .unionByName(execution_nodes(spark, d).select(F.lit("execution_records").alias("origin"), "record_id", *columns))
    )


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the extractions by type and depth."""
    return video_nodes(spark, d).groupBy("type", "depth").agg(F.count("*").alias("n"), F.count_if("is_null").alias("n_null"))


def p3_actions(spark: SparkSession, d: str) -> DataFrame:
    """The actions of all extractions as a flat table, with their actor."""
    nodes = materialize(video_nodes(spark, d, types=["actions", "actor"]))
    shape = {"name": "string", "action_type": "string", "sequence_index": "int", "timestamp_start_seconds": "double", "timestamp_end_seconds": "double", "confidence": "double"}
    actions = node_table(nodes, "extraction_id", "actions", shape, of="")
    actors = node_table(nodes, "extraction_id", "actor", {"name": "string"}, of="actions").select("extraction_id", F.col("parent_pre").alias("pre"), F.col("name").alias("actor"))
    return actions.join(actors, ["extraction_id", "pre"], "left").select("extraction_id", "pos", *shape, "actor")


def p3_parameters(spark: SparkSession, d: str) -> DataFrame:
    """The parameters of actions as a flat table, with the place of the action
    that contains them."""
    nodes = materialize(video_nodes(spark, d, types=["actions", "parameters"]))
    kind, depth = F.col("type"), F.col("depth")
    inside = link(nodes, "extraction_id", (kind == "parameters") & (depth == 2), (kind == "actions") & (depth == 1), {"pos": "action_pos"})
    shape = {"name": "string", "parameter_type": "string", "unit": "string", "nominal_value": "double"}
    return inside.where("not is_null").select("extraction_id", "action_pos", "pos", *(F.try_element_at("attributes", F.lit(c)).try_cast(t).alias(c) for c, t in shape.items()))


def p3_steps(spark: SparkSession, d: str) -> DataFrame:
    """The step executions of procedures as a flat table: the execution's own
    fields, and those of its step and of who did it."""
    nodes = materialize(execution_nodes(spark, d, types=["step_executions", "step", "executed_by"]))
    steps = node_table(nodes, "record_id", "step_executions", {"status": "string", "actual_duration_seconds": "int"}, of="")
    for kind, shape in (("step", {"name": "string", "step_number": "int", "step_type": "string"}), ("executed_by", {"name": "string", "role": "string"})):
        inner = node_table(nodes, "record_id", kind, shape, of="step_executions").where("pos = 0")
        steps = steps.join(inner.select("record_id", F.col("parent_pre").alias("pre"), *(F.col(c).alias(f"{kind}_{c}") for c in shape)), ["record_id", "pre"], "left")
    return steps.drop("pre", "post", "parent_pre")


QUERIES = {"p3_found": p3_found, "p3_nodes": p3_nodes, "p3_counts": p3_counts, "p3_actions": p3_actions, "p3_parameters": p3_parameters, "p3_steps": p3_steps}

_WORDS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0]+"
_NAME = f"trim(regexp_replace(lower({{}}), '{_WORDS}', ' ', 'g'))"
#: Payloads as JSON: a text's own quoting, code fences and a remark in front are removed.
_PAYLOAD = """
raw as (select distinct on (record_id) record_id, record_type, trim(payload) p from execution_records where payload is not null),
bare as (select record_id, record_type, case when p like '"%' and json_valid(p) then json_extract_string(p, '$') else p end p from raw),
cut as (select record_id, record_type, rtrim(regexp_replace(substr(p, strpos(p, '{')), '```\\s*$', ''), E' \\n\\t\\r') p from bare where strpos(p, '{') > 0),
j as (select record_id, record_type, p::json j from cut where json_valid(p)),
"""

#: What the elements of a list contain.
_INSIDE = {
    "actions": ["actor", "scene", "provenance"], "uses_tool": ["action", "tool", "provenance"], "acts_on_object": ["action", "object"], "action_order": ["before", "after"], "action_causes": ["cause", "effect"],
    "part_of_procedure": ["action", "procedure"], "observed_in_scene": ["action", "scene"],
}
_COUNTS = ["select '' as \"type\", 0 as depth, count(*) n, 0 n_null from v"] + [
    part for name in LISTS for part in [
        f"select '{name}', 1, count(*), count(*) filter (x is null) from e_{name}",
        *(f"select '{inner}', 2, count(*), 0 from e_{name} where x.\"{inner}\" is not null" for inner in _INSIDE.get(name, [])),
        *(["select 'parameters', 2, count(*), count(*) filter (y is null) from (select unnest(x.parameters) y from e_actions)"] if name == "actions" else []),
    ]
]

SQL = {
    "p3_counts": f"""
with v as (select distinct on (extraction_id) * from video_extractions), {", ".join(f"e_{name} as (select unnest({name}) x from v)" for name in LISTS)},
c as ({" union all ".join(_COUNTS)})
select "type", depth, cast(sum(n) as bigint) n, cast(sum(n_null) as bigint) n_null from c group by all having sum(n) > 0""",
    "p3_actions": """
with v as (select distinct on (extraction_id) * from video_extractions), a as (select extraction_id, cast(generate_subscripts(actions, 1) - 1 as int) pos, unnest(actions) x from v)
select extraction_id, pos, x.name, x.action_type, x.sequence_index, x.timestamp_start_seconds, x.timestamp_end_seconds, x.confidence, x.actor.name actor from a where x is not null""",
    "p3_parameters": """
with v as (select distinct on (extraction_id) * from video_extractions), a as (select extraction_id, cast(generate_subscripts(actions, 1) - 1 as int) action_pos, unnest(actions) x from v),
p as (select extraction_id, action_pos, cast(generate_subscripts(x.parameters, 1) - 1 as int) pos, unnest(x.parameters) y from a)
select extraction_id, action_pos, pos, y.name, y.parameter_type, y.unit, y.nominal_value from p where y is not null""",
    "p3_found": f"""
with v as (select distinct on (extraction_id) * from video_extractions),
scene as (select extraction_id, unnest(scenes) s, generate_subscripts(scenes, 1) - 1 pos from v),
act as (select extraction_id, unnest(actions) s, generate_subscripts(actions, 1) - 1 pos from v),
uses as (select extraction_id, unnest(uses_tool) s, generate_subscripts(uses_tool, 1) - 1 pos from v),
scene_at as (select extraction_id, {_NAME.format("s.name")} n, min(pos) p from scene where s.name is not null group by all),
act_at as (select extraction_id, {_NAME.format("s.name")} n, min(pos) p from act where s.name is not null group by all),
{_PAYLOAD}
steps as (
  select record_id, 0 parent_pos, j s from j where coalesce(record_type = 'StepExecution', json_extract(j, '$.procedure') is null and json_extract(j, '$.step_executions') is null)
  union all
  select record_id, unnest(range(n)), unnest(e) from (
    select record_id, case when json_type(x) = 'OBJECT' then [x] else cast(x as json[]) end e, len(e) n from (select record_id, json_extract(j, '$.step_executions') x from j)
    where json_type(x) in ('OBJECT', 'ARRAY'))),
obs as (select record_id, parent_pos, case when json_type(y) = 'OBJECT' and json_type(json_extract(y, '$.items')) = 'ARRAY' then json_extract(y, '$.items') else y end x
  from (select *, coalesce(json_extract(s, '$.observed_parameters'), json_extract(s, '$.observedParameters')) y from steps)),
el as (select record_id, parent_pos, unnest(e) x, unnest(range(len(e))) pos from (
    select record_id, parent_pos, case when json_type(x) = 'OBJECT' then [x] else cast(x as json[]) end e from obs where json_type(x) in ('OBJECT', 'ARRAY')))
select 'actions' child, a.extraction_id parent_id, cast(coalesce(p, -1) as int) parent_pos, cast(pos as int) pos
from act a left join scene_at on scene_at.extraction_id = a.extraction_id and n = {_NAME.format("a.s.scene.name")} and n <> '' where a.s is not null
union all
select 'uses_tool', u.extraction_id, cast(coalesce(p, -1) as int), cast(pos as int)
from uses u left join act_at on act_at.extraction_id = u.extraction_id and n = {_NAME.format('u.s."action".name')} and n <> '' where u.s is not null
union all select 'observed_parameters', record_id, cast(parent_pos as int), cast(pos as int) from el where x is not null and json_type(x) <> 'NULL'""",
}
