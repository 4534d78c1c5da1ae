"""Queries on property graphs, schema checks and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import MatchStrategy
from ..functions.metrics import with_prf1
from ..functions.text import WS
from ..operators.graph import (
    ENTITY_SECTIONS, RELATION_SECTIONS, actions_using_tool, build_property_graph, cluster_nodes, effects_caused_by, exact_node_ids, find_nodes, incoming, merge_clusters, merge_nodes, node_id,
    nodes_by_id, ordered_actions, outgoing, part_of_graph, tools_for_action, union_all,
)
from ..operators.runs import compare_executions, flatten_execution, record_run
from ..schema import ENUMS, RECORDS, fields, validated
from ..session import materialize, scratch_path
from ..sources.extract import ExtractorSettings, dump_json, extract_list, extract_records, rule_backend, rule_backend_one
from ..sources.gold import GOLD_TYPES, gold_rows
from ..sources.tables import table
from ..streaming.graph_merge import as_states, merge_stream, merged_states, nodes_of
from .evaluation import norm, toks


def graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return build_property_graph(table(spark, d, "video_extractions").dropDuplicates(["extraction_id"]), "extraction_id")


def lookups(spark: SparkSession, d: str, label: str) -> DataFrame:
    """The names of tool records of an extraction, as queries to its graph."""
    rows = table(spark, d, "video_extractions").dropDuplicates(["extraction_id"]).select("extraction_id", F.explode("actions" if label == "Action" else "tools").alias("x"))
    return rows.where("x.name is not null").select(F.col("extraction_id").alias("graph_id"), F.col("x.name").alias("query")).distinct()


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").dropDuplicates(["graph_id", "ord"])


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs(spark, d)[0].select("graph_id", "node_id", "label", "name", F.size("properties").cast("bigint").alias("n_properties"))


def graph_properties(spark: SparkSession, d: str) -> DataFrame:
    return graphs(spark, d)[0].select("graph_id", "node_id", F.explode("properties").alias("key", "value")).where("key <> 'provenance'")


def graph_properties_all(spark: SparkSession, d: str) -> DataFrame:
    """With the provenance of actions as JSON text, which SQL cannot print."""
    return graphs(spark, d)[0].select("graph_id", "node_id", F.explode("properties").alias("key", "value"))


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs(spark, d)[1].select("graph_id", "edge_id", "type", "src", "dst")


def edge_properties(spark: SparkSession, d: str) -> DataFrame:
    return graphs(spark, d)[1].select("graph_id", "type", "src", "dst", F.explode("properties").alias("key", "value"))


def property_merge(spark: SparkSession, d: str) -> DataFrame:
    """Node records merged: first name, last value of each property."""
    return merge_nodes(mentions(spark, d)).select("graph_id", "node_id", "name", F.explode_outer("properties").alias("key", "value"))


def streamed_merge(spark: SparkSession, d: str) -> DataFrame:
    """Node records as a stream, merged batch by batch: what property_merge
    gives of the whole table."""
    rows = table(spark, d, "nodes")
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/[n]odes.parquet")  # a pattern, since the table may be a file or a folder
    path = scratch_path(spark)
    merge_stream(stream, f"{path}/states", f"{path}/log", buckets=16, availableNow=True).awaitTermination()
    nodes = nodes_of(merged_states(spark, f"{path}/states", as_states(rows).schema))
    return nodes.select("graph_id", "node_id", "name", F.explode_outer("properties").alias("key", "value"))


def node_id_suffix(spark: SparkSession, d: str) -> DataFrame:
    return exact_node_ids(mentions(spark, d)).select("graph_id", "node_id", "label", "name")


def token_clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster_nodes(mentions(spark, d), MatchStrategy.TOKEN_OVERLAP, 0.6).select("graph_id", "label", "ord", "node_ord")


def _part(spark: SparkSession, d: str, labels: tuple[str, ...], types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    return part_of_graph(table(spark, d, "video_extractions").dropDuplicates(["extraction_id"]), "extraction_id", labels, types)


def find_node(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _part(spark, d, ("Tool",), ())
    return find_nodes(nodes, lookups(spark, d, "Tool"), "Tool", MatchStrategy.TOKEN_OVERLAP, 0.6).select("graph_id", "query", "node_id", F.round("score", 6).alias("score"))


def find_node_normalized(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = _part(spark, d, ("Action",), ())
    return find_nodes(nodes, lookups(spark, d, "Action"), "Action").select("graph_id", "query", "node_id", "score")


def find_node_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as names of nodes: for each the nearest one of the next label."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("graph_id"), F.lit("Vector").alias("label"), F.col("vec_id").cast("string").alias("node_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("name"))
    asked = v.select((F.col("graph_id") + 1).alias("graph_id"), F.col("name").alias("query"), F.col("node_id").alias("asked"))
    found = find_nodes(v, asked, "Vector", MatchStrategy.EMBEDDING, 0.2)
    return asked.join(found, ["graph_id", "query"]).select("graph_id", "asked", "node_id", F.round("score", 6).alias("score"))


def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The tools that are mentioned by node records, looked up in the graphs of
    the extractions; some are not there."""
    asked = mentions(spark, d).where("label = 'Tool'").select("graph_id", node_id(F.col("label"), F.col("name")).alias("node_id"))
    return nodes_by_id(_part(spark, d, ("Tool",), ())[0], asked).select("graph_id", "node_id", "name", "found")


def token_merge(spark: SparkSession, d: str) -> DataFrame:
    """Nodes merged by token overlap, with their merged properties."""
    return merge_clusters(mentions(spark, d), MatchStrategy.TOKEN_OVERLAP, 0.6).select("graph_id", "node_id", "name", F.explode_outer("properties").alias("key", "value"))


def outgoing_query(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graphs(spark, d)
    return outgoing(edges, nodes.where("label = 'Action'"), "USES_TOOL").select("graph_id", "edge_id", "src", "dst")


def incoming_query(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graphs(spark, d)
    return incoming(edges, nodes.where("label = 'Actor'")).select("graph_id", "edge_id", "src", "dst")


def tools_for_action_query(spark: SparkSession, d: str) -> DataFrame:
    return tools_for_action(*_part(spark, d, ("Action", "Tool"), ("USES_TOOL",)), lookups(spark, d, "Action")).select("graph_id", "query", "node_id", "name")


def actions_using_tool_query(spark: SparkSession, d: str) -> DataFrame:
    return actions_using_tool(*_part(spark, d, ("Action", "Tool"), ("USES_TOOL",)), lookups(spark, d, "Tool")).select("graph_id", "query", "node_id", "name")


def effects_query(spark: SparkSession, d: str) -> DataFrame:
    return effects_caused_by(*_part(spark, d, ("Action",), ("CAUSES",)), lookups(spark, d, "Action")).select("graph_id", "query", "node_id", "name")


def ordered_actions_query(spark: SparkSession, d: str) -> DataFrame:
    return ordered_actions(graphs(spark, d)[0]).select("graph_id", "node_id", F.col("place").cast("bigint").alias("place"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each label and edges of each type over all graphs."""
    nodes, edges = graphs(spark, d)
    return nodes.groupBy(F.lit("node").alias("kind"), "label").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("label")).agg(F.count("*").alias("n")))


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with parameters as JSON records: names, domains, types."""
    p = table(spark, d, "process_parameters").dropDuplicates(["param_id"])
    payload = F.to_json(F.struct(*(f.name for f in fields("ProcessParameter"))))
    checked = validated(p.select("param_id", payload.alias("payload")), "payload", "ProcessParameter")
    return checked.select("param_id", F.size("violations").cast("bigint").alias("n_violations"), F.array_join("violations", "; ").alias("violations"), F.col("record.name").alias("name"))


def _executions(spark: SparkSession, d: str) -> DataFrame:
    """Execution payloads with the record type they are checked as: the declared
    one, or what the payload looks like where none is declared."""
    e = table(spark, d, "execution_records").dropDuplicates(["record_id"])
    declared = F.coalesce(F.col("record_type").isin("StepExecution", "ProcedureExecution"), F.lit(False))
    untyped = F.when(F.col("record_type").isNull(), "record_type: missing").when(~declared, "record_type: domain")
    of_procedure = F.try_variant_get(F.try_parse_json("payload"), "$.procedure", "variant").isNotNull()
    kind = F.when(declared, F.col("record_type")).when(of_procedure, "ProcedureExecution").otherwise("StepExecution")
    return e.select("record_id", "payload", kind.alias("kind"), untyped.alias("violation"))


def _violations_of(rows: DataFrame, kind: str) -> DataFrame:
    checked = validated(rows.where(F.col("kind") == kind).select("record_id", "payload"), "payload", kind)
    return checked.select("record_id", F.explode("violations").alias("violation"))


def step_violations(spark: SparkSession, d: str) -> DataFrame:
    """All violations of payloads that are steps as they were done."""
    return _violations_of(_executions(spark, d), "StepExecution")


def procedure_violations(spark: SparkSession, d: str) -> DataFrame:
    """All violations of payloads that are procedures as they were done, down to
    the step of the step execution that a quality check is about."""
    return _violations_of(_executions(spark, d), "ProcedureExecution")


def execution_violations(spark: SparkSession, d: str) -> DataFrame:
    """All violations of execution payloads of both record types. A record
    without a declared type has that as a violation too."""
    rows = _executions(spark, d)
    return rows.where("violation is not null").select("record_id", "violation").unionByName(_violations_of(rows, "StepExecution")).unionByName(_violations_of(rows, "ProcedureExecution"))


def worker_violations(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "workers").dropDuplicates(["worker_rec_id"])
    checked = validated(w.select("worker_rec_id", F.to_json(F.struct("name", "role", "expertise_level", "certifications")).alias("payload")), "payload", "Worker")
    return checked.select("worker_rec_id", F.array_join("violations", "; ").alias("violations"), F.coalesce(F.size("record.certifications"), F.lit(0)).alias("n")).select(
        "worker_rec_id", "violations", F.greatest("n", F.lit(0)).cast("bigint").alias("n_certifications"))


def json_dump(spark: SparkSession, d: str) -> DataFrame:
    """Extraction results as indented JSON, with nulls and time stamps."""
    t = table(spark, d, "extraction_results").dropDuplicates(["result_id"])
    return dump_json(t, "result_id", "run_id", "extraction_model", "extraction_timestamp", "n_entities")


def _procedures(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that are executed procedures as records of that type."""
    rows = table(spark, d, "execution_records").dropDuplicates(["record_id"]).where("record_type = 'ProcedureExecution'")
    return validated(rows.select("record_id", "procedure_id", "payload"), "payload", "ProcedureExecution").where("record is not null")


def execution_summary(spark: SparkSession, d: str) -> DataFrame:
    """Steps, checks and feedback of executed procedures as rows."""
    return flatten_execution(_procedures(spark, d), "record_id")


def compare_executions_query(spark: SparkSession, d: str) -> DataFrame:
    """The first execution of each procedure against the last one."""
    rows = materialize(_procedures(spark, d).where("procedure_id is not null").select("procedure_id", "record_id", "record"))
    first, last = (rows.groupBy("procedure_id").agg(f("record", "record_id").alias("record")) for f in (F.min_by, F.max_by))
    return compare_executions(first, last, "procedure_id")


def step_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Steps as they were done, with what is_critical is where it is not said."""
    rows = table(spark, d, "execution_records").dropDuplicates(["record_id"]).where("record_type = 'StepExecution'")
    checked = validated(rows.select("record_id", "payload"), "payload", "StepExecution").where("record.step is not null")
    return checked.select("record_id", F.col("record.step.name").alias("name"), F.col("record.step.is_critical").alias("is_critical"))


def json_dump_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Whole video extractions, nested records included, as JSON, read back."""
    t = table(spark, d, "video_extractions")
    return dump_json(t, *t.columns).select(F.from_json("json", t.schema).alias("r")).select("r.*")


def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    """Tools that the rule backend finds in chunk texts."""
    chunks = table(spark, d, "extraction_results").dropDuplicates(["result_id"]).where("source_chunk is not null").select("result_id", "source_chunk")
    good, _ = extract_list(chunks, "source_chunk", "Tool", rule_backend)
    return good.select("result_id", F.col("pos").cast("bigint").alias("pos"), F.col("record.name").alias("name"), F.col("record.model").alias("model"))


def _one_tool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, d, "extraction_results").dropDuplicates(["result_id"]).where("source_chunk is not null").select("result_id", "source_chunk")
    return extract_records(chunks, "source_chunk", "Tool", rule_backend_one, ExtractorSettings(max_retries=1))


def extract_one(spark: SparkSession, d: str) -> DataFrame:
    """The first tool that the rule backend finds in each chunk text."""
    return _one_tool(spark, d)[0].select("result_id", F.col("record.name").alias("name"), F.col("record.manufacturer").alias("manufacturer"))


def extract_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """The chunks where what came back is no tool, and why."""
    return _one_tool(spark, d)[1].select("result_id", F.array_join("violations", "; ").alias("violations"))


def config_violations(spark: SparkSession, d: str) -> DataFrame:
    """The settings of all runs, checked against their record type."""
    runs = table(spark, d, "experiment_runs").withColumnRenamed("run_at", "timestamp")
    names = [f.name for f in fields("ExperimentConfig") if f.name in runs.columns]
    checked = validated(runs.select("run_id", F.to_json(F.struct(*names)).alias("payload")), "payload", "ExperimentConfig")
    return checked.select("run_id", F.array_join("violations", "; ").alias("violations"), F.col("record.temperature").alias("temperature"), F.col("record.num_few_shot_examples").alias("num_few_shot_examples"), F.col("record.timestamp").cast("string").alias("stamp"))


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Runs with the metrics of their counts: entities that a result states
    against tools that the rule backend finds in its text."""
    r = table(spark, d, "extraction_results").dropDuplicates(["result_id"]).where("run_id is not null").select("run_id", "result_id", F.coalesce("n_entities", F.lit(0)).alias("stated"))
    found = extract_entities(spark, d).groupBy("result_id").agg(F.count("*").alias("found"))
    n = r.join(found, "result_id", "left").select("run_id", "stated", F.coalesce("found", F.lit(0)).alias("found"))
    counts = n.groupBy("run_id", F.lit("tools").alias("category")).agg(
        F.sum(F.least("stated", "found")).alias("true_positives"), F.sum(F.greatest(F.col("found") - F.col("stated"), F.lit(0))).alias("false_positives"), F.sum(F.greatest(F.col("stated") - F.col("found"), F.lit(0))).alias("false_negatives"),
    )
    done = record_run(table(spark, d, "experiment_runs"), {"entity": with_prf1(counts)}, "true_positives", "precision", "recall", "f1")
    m = F.try_element_at("entity_metrics", F.lit("tools"))
    return done.select("run_id", "experiment_name", *(m[c].alias(c) for c in ("true_positives", "precision", "recall", "f1")))


def gold_levels(spark: SparkSession, d: str) -> DataFrame:
    """The gold records of the five levels, checked against their types."""
    rows = gold_rows(spark)
    checked = [validated(rows.where(F.col("record_type") == t), "payload", t).select("level", "record_type", "pos", F.size("violations").cast("bigint").alias("n_violations"), "payload") for t in GOLD_TYPES]
    return union_all(checked).select("level", "record_type", "pos", "n_violations", F.get_json_object("payload", "$.name").alias("name"))


QUERIES = {
    "graph_nodes": graph_nodes, "graph_properties": graph_properties, "graph_properties_all": graph_properties_all, "graph_edges": graph_edges, "edge_properties": edge_properties, "property_merge": property_merge, "streamed_merge": streamed_merge,
    "node_id_suffix": node_id_suffix, "token_clusters": token_clusters, "token_merge": token_merge, "find_node": find_node, "find_node_normalized": find_node_normalized, "find_node_embedding": find_node_embedding, "node_by_id": node_by_id, "outgoing": outgoing_query, "incoming": incoming_query,
    "tools_for_action": tools_for_action_query, "actions_using_tool": actions_using_tool_query, "effects_caused_by": effects_query, "ordered_actions": ordered_actions_query,
    "graph_summary": graph_summary, "schema_violations": schema_violations, "step_violations": step_violations, "procedure_violations": procedure_violations, "execution_violations": execution_violations, "worker_violations": worker_violations,
    "json_dump": json_dump, "execution_summary": execution_summary, "compare_executions": compare_executions_query, "step_defaults": step_defaults, "gold_levels": gold_levels, "json_dump_extractions": json_dump_extractions, "extract_entities": extract_entities, "extract_one": extract_one, "extract_quarantine": extract_quarantine, "config_violations": config_violations, "run_results": run_results,
}

# The same in SQL. Mentions of nodes (g, label, name, ord, and properties as rows
# k, val) and of edges, section by section.
_FIELDS = {
    "scenes": ["segment_id", "timestamp_start_seconds", "timestamp_end_seconds", "location", "confidence"], "procedures": ["domain"], "actors": ["role"],
    "actions": ["action_type", "sequence_index", "timestamp_start_seconds", "timestamp_end_seconds", "confidence"], "tools": ["tool_type", "manufacturer", "model"], "objects": ["object_type", "state"],
    "uses_tool": ["confidence"], "acts_on_object": ["role", "confidence"], "action_order": ["confidence"], "action_causes": ["rationale", "confidence"], "part_of_procedure": [], "observed_in_scene": [],
}


def _graph_sql() -> str:
    ctes = ["v as (select distinct on (extraction_id) * from video_extractions)"]
    nodes, props, edges, eprops = [], [], [], []

    def kv(e: str, keys: list[str]) -> str:
        return f"unnest([{', '.join(repr(k) for k in keys)}]) k, unnest([{', '.join(f'cast({e}.{k} as varchar)' for k in keys)}]) val"

    for s, (section, label) in enumerate(ENTITY_SECTIONS):
        ctes.append(f"s{s} as (select * from (select extraction_id g, unnest(range(len({section}))) i, unnest({section}) x from v) where x is not null)")
        at = f"{s << 40} + i * 256"
        nodes.append(f"select g, '{label}' label, x.name, {at} ord from s{s}")
        props.append(f"select g, '{label}' label, x.name, {at} ord, {kv('x', _FIELDS[section])} from s{s}")
        if label == "Action":
            nodes.append(f"select g, 'Actor', x.actor.name, {at} + 1 from s{s}")
            nodes.append(f"select g, 'Scene', x.scene.name, {at} + 2 from s{s}")
            props.append(f"select g, 'Actor', x.actor.name, {at} + 1, 'role', x.actor.role from s{s}")
            edges.append(f"select g, 'PERFORMED_BY' t, 'Action' la, x.name a, 'Actor' lb, x.actor.name b, {at} + 1 ord from s{s}")
            edges.append(f"select g, 'OBSERVED_IN', 'Action', x.name, 'Scene', x.scene.name, {at} + 2 from s{s}")
    for s, (section, kind, (fa, la), (fb, lb)) in enumerate(RELATION_SECTIONS, len(ENTITY_SECTIONS)):
        ctes.append(f"s{s} as (select * from (select extraction_id g, unnest(range(len({section}))) i, unnest({section}) x from v) where x is not null)")
        at = f"{s << 40} + i * 256"
        nodes += [f"select g, '{la}', x.\"{fa}\".name, {at} from s{s}", f"select g, '{lb}', x.\"{fb}\".name, {at} + 1 from s{s}"]
        edges.append(f"select g, '{kind}', '{la}', x.\"{fa}\".name, '{lb}', x.\"{fb}\".name, {at} + 2 from s{s}")
        if _FIELDS[section]:
            eprops.append(f"select g, '{kind}' t, '{la}' la, x.\"{fa}\".name a, '{lb}' lb, x.\"{fb}\".name b, {at} + 2 ord, {kv('x', _FIELDS[section])} from s{s}")
    key = f"label || ':' || {norm('name')}"
    ctes += [
        f"nm as ({' union all '.join(nodes)})", f"pm as ({' union all '.join(props)})", f"em as ({' union all '.join(edges)})", f"ep as ({' union all '.join(eprops)})",
        f"nodes2 as (select g graph_id, {key} node_id, arg_min(label, ord) label, arg_min(name, ord) name, min(ord) ord from nm where name is not null group by 1, 2)",
        f"props2 as (select g graph_id, {key} node_id, k \"key\", arg_max(val, ord) \"value\" from pm where name is not null and val is not null group by 1, 2, 3)",
        f"edges1 as (select g graph_id, t \"type\", la || ':' || {norm('a')} src, lb || ':' || {norm('b')} dst, min(ord) ord from em where a is not null and b is not null group by all)",
        "edges2 as (select *, 'e' || row_number() over (partition by graph_id order by ord) edge_id from edges1)",
        f"eprops2 as (select g graph_id, t \"type\", la || ':' || {norm('a')} src, lb || ':' || {norm('b')} dst, k \"key\", arg_max(val, ord) \"value\" from ep where a is not null and b is not null and val is not null group by all)",
        "seen as (select g graph_id, count(*) from nm group by 1)",
        "prov as (select distinct g graph_id, 'Action:' || " + norm("x.name") + " node_id from s3 where x.name is not null and x.provenance is not null)",
    ]
    return ", ".join(ctes)


_G = f"with {_graph_sql()}"


def _asked(section: str) -> str:
    return f"asked as (select distinct extraction_id graph_id, x.name query from (select extraction_id, unnest({section}) x from v) where x.name is not null)"


def _found(label: str) -> str:
    t, x = toks("query"), toks("name")
    score = f"(case when len({t}) = 0 then case when len({x}) = 0 then 1.0 else 0.0 end else len(list_intersect({t}, {x})) / len({t}) end)"
    return f"""scored as (select graph_id, query, node_id, ord, {score} score from asked join nodes2 using (graph_id) where label = '{label}'),
found as (select graph_id, query, node_id, score from scored where score >= 0.6 qualify row_number() over (partition by graph_id, query order by score desc, ord) = 1)"""


def _step(section: str, label: str, kind: str, here: str, there: str) -> str:
    return f"""{_G}, {_asked(section)}, {_found(label)}
select f.graph_id, f.query, e.{there} node_id, n.name from found f join edges2 e on e.graph_id = f.graph_id and e.{here} = f.node_id and e."type" = '{kind}' join nodes2 n on n.graph_id = e.graph_id and n.node_id = e.{there}"""


_PROCEDURES = """with o as (select record_id, procedure_id, payload::json o from (select distinct on (record_id) * from execution_records) where record_type = 'ProcedureExecution' and json_valid(payload) and json_type(payload) = 'OBJECT')"""
_MENTIONS = "m as (select distinct on (graph_id, ord) * from nodes)"
_CLUSTERS = f"""{_MENTIONS}, l as (select graph_id, label, ord, {toks('name')} t, row_number() over (partition by graph_id, label order by ord) rn from m),
r as (
  select distinct graph_id, label, cast(0 as bigint) rn, cast([] as struct(ord bigint, t varchar[])[]) made, cast(null as bigint) ord, cast(null as bigint) node_ord from l
  union all
  select graph_id, label, rn, case when best is null then list_append(made, {{'ord': ord, 't': t}}) else made end, ord, coalesce(best.ord, ord)
  from (select l.graph_id, l.label, l.rn, l.ord, l.t, r.made,
      list_sort(list_filter(list_transform(r.made, lambda z: {{'ns': -len(list_intersect(l.t, z.t)) / len(l.t), 'ord': z.ord}}), lambda z: -z.ns >= 0.6))[1] best
    from r join l on l.graph_id = r.graph_id and l.label = r.label and l.rn = r.rn + 1))"""
_PTYPES = ", ".join(f"'{x}'" for x in ENUMS["parameter_type"])


def _checked_sql(*records: str) -> str:
    """Violations of execution payloads, from one list of JSON objects for each
    place where the types nest."""
    ctes, found = [], []

    def wrong(source: str, at: str, what: str, test: str) -> None:
        found.append(f"select record_id, '{at}: {what}' violation from {source} where {test}")

    def fits(kind: str, j: str) -> str:
        text, of = f"json_extract_string({j}, '$')", f"json_type({j})"
        number = f"({of} in ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') or {of} = 'VARCHAR' and try_cast({text} as double) is not null)"
        if kind == "str" or kind in ENUMS:
            return f"{of} = 'VARCHAR'"
        if kind == "float":
            return number
        if kind == "int":
            return f"({of} in ('BIGINT', 'UBIGINT', 'BOOLEAN') or {of} = 'DOUBLE' and try_cast({text} as double) = floor(try_cast({text} as double)) or {of} = 'VARCHAR' and regexp_full_match(trim({text}), '[+-]?[0-9]+([.]0+)?'))"
        if kind == "bool":
            return f"{of} not in ('OBJECT', 'ARRAY') and lower({text}) in ('true', 't', 'yes', 'y', 'on', '1', '1.0', 'false', 'f', 'no', 'n', 'off', '0', '0.0')"
        return f"({of} in ('BIGINT', 'UBIGINT', 'DOUBLE') or {of} = 'VARCHAR' and try_cast({text} as timestamp) is not null)"

    def walk(record: str, source: str, path: str) -> None:
        for f in fields(record):
            at, j = f"{path}{f.name}", f"json_extract(j, '$.{f.name}')"
            if f.required:
                wrong(source, at, "missing", f"{j} is null")
            if f.required or f.default is not None:
                wrong(source, at, "null", f"json_type({j}) = 'NULL'")
            here = source
            if f.many:
                wrong(source, at, "type", f"json_type({j}) not in ('ARRAY', 'NULL')")
                here = f"x{len(ctes)}"
                ctes.append(f"{here} as (select record_id, unnest(cast({j} as json[])) j from {source} where json_type({j}) = 'ARRAY')")
                j = "j"
            elif f.kind in RECORDS:
                here = f"x{len(ctes)}"
                ctes.append(f"{here} as (select record_id, {j} j from {source} where json_type({j}) <> 'NULL')")
                j = "j"
            if f.kind in RECORDS:
                wrong(here, at, "type", "coalesce(json_type(j), 'NULL') <> 'OBJECT'")
                inner = f"x{len(ctes)}"
                ctes.append(f"{inner} as (select record_id, j from {here} where json_type(j) = 'OBJECT')")
                walk(f.kind, inner, f"{at}.")
                continue
            wrong(here, at, "type", f"coalesce(not ({fits(f.kind, j)}), true)" if f.many else f"json_type({j}) <> 'NULL' and not ({fits(f.kind, j)})")
            if f.kind in ENUMS:
                wrong(here, at, "domain", f"json_type({j}) = 'VARCHAR' and json_extract_string({j}, '$') not in ({', '.join(repr(x) for x in ENUMS[f.kind])})")

    for record in records:
        ctes.append(f"k{record} as (select record_id, o from e where kind = '{record}')")
        found.append(f"select record_id, 'json' violation from k{record} where o is null")
        ctes.append(f"o{record} as (select record_id, o j from k{record} where o is not null)")
        walk(record, f"o{record}", "")
    if len(records) > 1:
        found += ["select record_id, 'record_type: missing' from e where record_type is null", "select record_id, 'record_type: domain' from e where record_type not in ('StepExecution', 'ProcedureExecution')"]
    return f"""with r as (select distinct on (record_id) record_id, record_type, case when json_valid(payload) and json_type(payload) = 'OBJECT' then payload::json end o from execution_records),
e as (select record_id, record_type, o, case when record_type in ('StepExecution', 'ProcedureExecution') then record_type when json_extract(o, '$.procedure') is not null then 'ProcedureExecution' else 'StepExecution' end kind from r),
{', '.join(ctes)}
{' union all '.join(found)}"""


SQL = {
    "graph_nodes": f"""{_G} select n.graph_id, n.node_id, label, name, (select count(*) from props2 p where p.graph_id = n.graph_id and p.node_id = n.node_id) + (select count(*) from prov p where p.graph_id = n.graph_id and p.node_id = n.node_id) n_properties from nodes2 n""",
    "graph_properties": f"{_G} select * from props2",
    "graph_edges": f'{_G} select graph_id, edge_id, "type", src, dst from edges2',
    "edge_properties": f"{_G} select * from eprops2",
    "property_merge": f"""with {_MENTIONS}, i as (select graph_id, name, ord, properties, label || ':' || {norm('name')} nid from m), f as (select graph_id, nid, arg_min(name, ord) name from i group by all),
p as (select graph_id, nid, ord, unnest(map_keys(properties)) k, unnest(map_values(properties)) v from i),
l as (select graph_id, nid, k "key", arg_max(v, ord) "value" from p where v is not null group by all)
select graph_id, nid node_id, name, "key", "value" from f left join l using (graph_id, nid)""",
    "node_id_suffix": f"""with {_MENTIONS}, i as (select graph_id, label, name, min(ord) ord, label || ':' || {norm('name')} base from m group by all),
k as (select *, row_number() over (partition by graph_id, base order by ord) c from i) select graph_id, case when c = 1 then base else base || ':' || c end node_id, label, name from k""",
    "token_clusters": f"with recursive {_CLUSTERS} select graph_id, label, ord, node_ord from r where rn > 0",
    "token_merge": f"""with recursive {_CLUSTERS}, j as (select m.*, r.node_ord from m join r on r.graph_id = m.graph_id and r.ord = m.ord where rn > 0),
f as (select graph_id, node_ord, name, label || ':' || {norm('name')} base from j where ord = node_ord),
k as (select *, row_number() over (partition by graph_id, base order by node_ord) c from f),
p as (select graph_id, node_ord, ord, unnest(map_keys(properties)) k, unnest(map_values(properties)) v from j),
q as (select graph_id, node_ord, k "key", arg_max(v, ord) "value" from p where v is not null group by all)
select graph_id, case when c = 1 then base else base || ':' || c end node_id, name, "key", "value" from k left join q using (graph_id, node_ord)""",
    "find_node_normalized": f"""{_G}, {_asked('actions')} select graph_id, query, node_id, 1.0::double score from asked join nodes2 using (graph_id) where label = 'Action' and {norm('query')} = {norm('name')}""",
    "find_node_embedding": """
with v as (select label, vec_id, cast(embedding as double[]) x from embeddings),
s as (select b.label graph_id, a.vec_id asked, b.vec_id id, greatest(0.0, list_cosine_similarity(a.x, b.x)) score from v a join v b on b.label = a.label + 1)
select graph_id, cast(asked as varchar) asked, cast(id as varchar) node_id, round(score, 6) score from s where score >= 0.2 qualify row_number() over (partition by graph_id, asked order by score desc, id) = 1""",
    "node_by_id": f"""{_G}, {_MENTIONS}, want as (select distinct graph_id, 'Tool:' || {norm('name')} node_id from m where label = 'Tool' and name is not null)
select graph_id, node_id, name, n.node_id is not null found from want left join (select * from nodes2 where label = 'Tool') n using (graph_id, node_id)""",
    "find_node": f"{_G}, {_asked('tools')}, {_found('Tool')} select graph_id, query, node_id, cast(round(score, 6) as double) score from found",
    "outgoing": f"{_G} select graph_id, edge_id, src, dst from edges2 where \"type\" = 'USES_TOOL' and src like 'Action:%'",
    "incoming": f"{_G} select graph_id, edge_id, src, dst from edges2 where dst like 'Actor:%'",
    "tools_for_action": _step("actions", "Action", "USES_TOOL", "src", "dst"),
    "actions_using_tool": _step("tools", "Tool", "USES_TOOL", "dst", "src"),
    "effects_caused_by": _step("actions", "Action", "CAUSES", "src", "dst"),
    "ordered_actions": f"""{_G} select n.graph_id, n.node_id, row_number() over (partition by n.graph_id order by coalesce(cast(p."value" as bigint), 1000000000), n.ord) place
from nodes2 n left join props2 p on p.graph_id = n.graph_id and p.node_id = n.node_id and p."key" = 'sequence_index' where label = 'Action'""",
    "graph_summary": f"{_G} select 'node' kind, label, count(*) n from nodes2 group by all union all select 'edge', \"type\", count(*) from edges2 group by all",
    "schema_violations": f"""with p as (select distinct on (param_id) param_id, name, parameter_type from process_parameters),
x as (select param_id, name, list_filter([case when name is null then 'name: missing' end, case when parameter_type not in ({_PTYPES}) then 'parameter_type: domain' end], lambda z: z is not null) l from p)
select param_id, cast(len(l) as bigint) n_violations, array_to_string(l, '; ') violations, name from x""",
    "step_violations": _checked_sql("StepExecution"),
    "procedure_violations": _checked_sql("ProcedureExecution"),
    "execution_violations": _checked_sql("StepExecution", "ProcedureExecution"),
    "worker_violations": f"""with w as (select distinct on (worker_rec_id) * from workers)
select worker_rec_id, array_to_string(list_filter([case when name is null then 'name: missing' end, case when role not in ({", ".join(repr(x) for x in ENUMS["role"])}) then 'role: domain' end,
  case when expertise_level not in ({", ".join(repr(x) for x in ENUMS["expertise"])}) then 'expertise_level: domain' end], lambda z: z is not null), '; ') violations, cast(coalesce(len(certifications), 0) as bigint) n_certifications from w""",
    "json_dump": r"""
with r as (select distinct on (result_id) * from extraction_results)
select printf(E'{\n  "result_id" : %s,\n  "run_id" : %s,\n  "extraction_model" : %s,\n  "extraction_timestamp" : %s,\n  "n_entities" : %s\n}', result_id::varchar, coalesce(run_id::varchar, 'null'),
  coalesce('"' || extraction_model || '"', 'null'), coalesce('"' || strftime(extraction_timestamp, '%Y-%m-%dT%H:%M:%S') || '"', 'null'), coalesce(n_entities::varchar, 'null')) json from r""",
    "execution_summary": f"""{_PROCEDURES},
x as (select record_id, 'step' part, '$.step.name' a, '$.status' b, '$.actual_duration_seconds' c, json_extract(o, '$.step_executions') l from o
  union all select record_id, 'check', '$.inspector.name', '$.result', '$.findings', json_extract(o, '$.quality_checks') from o
  union all select record_id, 'feedback', '$.reported_by.name', '$.feedback_type', '$.content', json_extract(o, '$.feedback') from o),
y as (select record_id, part, a, b, c, unnest(cast(l as json[])) j, unnest(range(cast(json_array_length(l) as bigint))) pos from x where json_type(l) = 'ARRAY')
select record_id, part, cast(pos as int) pos, case when json_type(json_extract(j, a)) = 'VARCHAR' then json_extract_string(j, a) end "name", case when json_type(json_extract(j, b)) = 'VARCHAR' then json_extract_string(j, b) end status,
  case when part = 'step' then cast(try_cast(json_extract_string(j, c) as bigint) as varchar) when json_type(json_extract(j, c)) = 'VARCHAR' then json_extract_string(j, c) end detail from y where json_type(j) = 'OBJECT'""",
    "compare_executions": f"""{_PROCEDURES},
s as (select procedure_id, record_id, {", ".join(f"coalesce(case when json_type(json_extract(o, '$.{c}')) = 'ARRAY' then json_array_length(o, '$.{c}') end, 0) {c}" for c in ("step_executions", "quality_checks", "feedback", "executed_by"))},
  case when json_type(json_extract(o, '$.supervised_by.name')) = 'VARCHAR' then json_extract_string(o, '$.supervised_by.name') end supervised_by, {", ".join(f"case when json_type(json_extract(o, '$.{c}')) = 'VARCHAR' then json_extract_string(o, '$.{c}') end {c}" for c in ("overall_status", "overall_result"))} from o where procedure_id is not null),
e as (select * from s qualify row_number() over (partition by procedure_id order by record_id) = 1), g as (select * from s qualify row_number() over (partition by procedure_id order by record_id desc) = 1)
select e.procedure_id, {", ".join(f"cast(e.{c} as int) expected_{c}, cast(g.{c} as int) got_{c}, e.{c} = g.{c} same_{c}" for c in ("step_executions", "quality_checks", "feedback", "executed_by"))}, {", ".join(f"e.{c} expected_{c}, g.{c} got_{c}" for c in ("supervised_by", "overall_status", "overall_result"))} from e join g using (procedure_id)""",
    "step_defaults": """
with r as (select distinct on (record_id) record_id, payload from execution_records where record_type = 'StepExecution'),
j as (select record_id, json_extract(payload, '$.step') s from r where json_valid(payload) and json_type(payload) = 'OBJECT')
select record_id, case when json_type(json_extract(s, '$.name')) = 'VARCHAR' then json_extract_string(s, '$.name') end "name",
  case when json_extract(s, '$.is_critical') is null then false else try_cast(json_extract_string(s, '$.is_critical') as boolean) end is_critical from j where json_type(s) = 'OBJECT'""",
    "gold_levels": """select * from (values (1, 'Tool', 0, 0::bigint, 'Fronius TPS 400i'), (1, 'Material', 1, 0, 'ER70S-6 Schweißdraht'), (1, 'Material', 2, 0, 'Schutzgas Argon/CO2 82/18'), (2, 'Procedure', 0, 0, 'MIG-Schweißung S235 T-Stoß'),
  (2, 'Step', 0, 0, 'Werkstück vorbereiten'), (2, 'Step', 1, 0, 'Heften'), (2, 'Step', 2, 0, 'Wurzellage'), (2, 'Step', 3, 0, 'Decklage'), (2, 'StepOrder', 0, 0, null), (2, 'StepOrder', 1, 0, null), (2, 'StepOrder', 2, 0, null),
  (3, 'ToolRequirement', 0, 0, null), (4, 'StepExecution', 0, 0, null), (5, 'ProcedureExecution', 0, 0, null)) t(level, record_type, pos, n_violations, name)""",
    "extract_entities": """with r as (select distinct on (result_id) result_id, source_chunk from extraction_results where source_chunk is not null),
m as (select result_id, regexp_extract_all(source_chunk, '[A-ZÄÖÜ][a-zäöüß]+ [A-Z]{2}-[0-9]+') l from r)
select result_id, cast(unnest(range(len(l))) as bigint) pos, unnest(l) name, split_part(unnest(l), ' ', 2) model from m""",
    "extract_one": """
with r as (select distinct on (result_id) result_id, regexp_extract(source_chunk, '[A-ZÄÖÜ][a-zäöüß]+ [A-Z]{2}-[0-9]+') n from extraction_results where source_chunk is not null)
select result_id, n "name", split_part(n, ' ', 1) manufacturer from r where n <> ''""",
    "extract_quarantine": """
with r as (select distinct on (result_id) result_id, regexp_extract(source_chunk, '[A-ZÄÖÜ][a-zäöüß]+ [A-Z]{2}-[0-9]+') n from extraction_results where source_chunk is not null)
select result_id, 'name: missing' violations from r where n = ''""",
    "config_violations": """
select run_id, array_to_string(list_filter([case when experiment_name is null then 'experiment_name: missing' end, case when domain is null then 'domain: missing' end, case when schema_level is null then 'schema_level: missing' end,
  case when model is null then 'model: missing' end, case when prompt_strategy is null then 'prompt_strategy: missing' end], lambda z: z is not null), '; ') violations, coalesce(temperature, 0.0) temperature, cast(num_few_shot_examples as bigint) num_few_shot_examples,
  strftime(run_at, '%Y-%m-%d %H:%M:%S') stamp from experiment_runs""",
    "run_results": """
with r as (select distinct on (result_id) result_id, run_id, coalesce(n_entities, 0) stated, coalesce(len(regexp_extract_all(source_chunk, '[A-ZÄÖÜ][a-zäöüß]+ [A-Z]{2}-[0-9]+')), 0) found from extraction_results where run_id is not null),
c as (select run_id, sum(least(stated, found)) tp, sum(greatest(found - stated, 0)) fp, sum(greatest(stated - found, 0)) fn from r group by 1),
m as (select run_id, cast(tp as bigint) true_positives, case when tp + fp > 0 then tp / (tp + fp) else 0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0 end q from c)
select e.run_id, experiment_name, true_positives, round(p, 4) "precision", round(q, 4) recall, round(case when p + q > 0 then 2 * p * q / (p + q) when p is not null then 0 end, 4) f1 from (select distinct on (run_id) * from experiment_runs) e left join m using (run_id)""",
}
SQL["streamed_merge"] = SQL["property_merge"]
