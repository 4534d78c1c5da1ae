"""Queries on comparing, assigning and scoring records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import MatchStrategy, compare_values, cosine, match_exact, match_normalized, match_token_overlap
from ..functions.metrics import format_prf1, micro_average, prf1, with_prf1
from ..functions.text import WS, normal, stripped, tokens
from ..operators.assign import candidates
from ..operators.evaluate import attributes, entity_detection, evaluate_level, level_pairs, relation_detection
from ..operators.graph import node_id, union_all
from ..operators.runs import compare_sizes, list_sizes, strategy_sweep
from ..session import materialize
from ..sources.tables import table

TRUSTED = ["asset_register", "vendor_sheet", "inspection_app"]
FIELDS = ["tool_type", "manufacturer", "model", "confidence"]


def tools(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tools").dropDuplicates(["tool_rec_id"])


def node_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes of trusted origins as expected records, the others as extracted;
    a graph is a group."""
    at = lambda k: F.try_element_at("properties", F.lit(k))
    rows = table(spark, d, "nodes").dropDuplicates(["graph_id", "ord"]).select(
        F.col("graph_id").alias("grp"), F.col("ord").alias("pos"), "name", "label", *(at(f).alias(f) for f in FIELDS[:3]), at("confidence").try_cast("double").alias("confidence"),
        F.coalesce(F.col("origin").isin(TRUSTED), F.lit(False)).alias("trusted"),
    )
    return rows.where("trusted").drop("trusted"), rows.where("not trusted").drop("trusted")


def worker_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Workers as badges name them, and as all other sources do; by site."""
    rows = table(spark, d, "workers").dropDuplicates(["worker_rec_id"]).select(F.col("site_code").alias("grp"), F.col("worker_rec_id").alias("pos"), "name", "source")
    return rows.where("source = 'badge_form'"), rows.where("source <> 'badge_form'")


def relation_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stated orders of actions as expected, causes as extracted relations of an
    extraction: does one action bring about the one that follows?"""
    rows = table(spark, d, "video_extractions").dropDuplicates(["extraction_id"])

    def side(column: str, before: str, after: str) -> DataFrame:
        r = rows.select(F.col("extraction_id").alias("grp"), F.posexplode(column).alias("pos", "r")).where("r is not null")
        return r.select("grp", F.col("pos").cast("bigint").alias("pos"), F.col(f"r.{before}.name").alias("before"), F.col(f"r.{after}.name").alias("after"))

    return side("action_order", "before", "after"), side("action_causes", "cause", "effect")


def match_exact_query(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_rec_id", match_exact(F.col("name"), F.col("tool_type")).alias("score"))


def match_normalized_query(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_rec_id", match_normalized(F.col("name"), F.col("tool_type")).alias("score"))


def token_overlap_query(spark: SparkSession, d: str) -> DataFrame:
    t = tools(spark, d).where("tool_type is not null and name is not null")
    return t.select("tool_rec_id", F.round(match_token_overlap(F.col("tool_type"), F.col("name")), 6).alias("score"))


def token_overlap_documents(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct tokens each document has, over whole texts."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(tokens(F.col("text"))).cast("bigint"), F.lit(None)).alias("n_tokens"), normal(F.col("text")).alias("n")).select(
        "doc_id", F.when(F.col("n").isNotNull(), F.col("n_tokens")).alias("n_tokens"), F.length("n").cast("bigint").alias("n_normal"))


def token_overlap_empty(spark: SparkSession, d: str) -> DataFrame:
    """Overlap where one or both sides may have no token."""
    t = tools(spark, d)
    return t.select("tool_rec_id", F.round(match_token_overlap(F.coalesce("tool_type", F.lit(" ")), F.coalesce("manufacturer", F.lit(""))), 6).alias("score"))


def token_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    """Listed makers and hand-typed names of which at least 0.6 of the maker's
    tokens are in the name: a fuzzy join through tokens."""
    makers = table(spark, d, "makers").select(F.lit(0).alias("g"), F.col("maker_id").alias("pos"), "name")
    typed = tools(spark, d).where("manufacturer is not null").select(F.lit(0).alias("g"), F.col("tool_rec_id").alias("pos"), F.col("manufacturer").alias("name"))
    found = candidates(makers, typed, "g", "name", least=0.6)
    return found.select(F.col("e").alias("maker_id"), F.col("x").alias("tool_rec_id"), F.round("score", 6).alias("score"))


def numeric_compare(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "process_parameters").dropDuplicates(["param_id"])
    c = compare_values(F.col("nominal_value"), F.col("max_value"), T.DoubleType(), T.DoubleType(), threshold=0.9)
    return p.select("param_id", F.round(c["score"], 9).alias("score"), c["match"].alias("hit"), c["strategy"].alias("strategy"))


def bool_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    late, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1")
    c = compare_values(late, urgent, T.BooleanType(), T.BooleanType())
    return o.groupBy(c["match"].alias("hit"), c["strategy"].alias("strategy"), c["expected"].alias("expected"), c["extracted"].alias("extracted")).agg(F.count("*").alias("n"))


def null_compare(spark: SparkSession, d: str) -> DataFrame:
    c = compare_values(F.col("model"), F.col("tool_type"), T.StringType(), T.StringType(), MatchStrategy.TOKEN_OVERLAP, 0.5)
    return tools(spark, d).select("tool_rec_id", c["match"].alias("hit"), F.round(c["score"], 6).alias("score"), c["strategy"].alias("strategy"))


def embedding_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with the one that follows it among those of its
    label."""
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.where("next is not null").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


def normalize_name(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_rec_id", node_id(F.lit("Tool"), F.col("name")).alias("node_id"))


def entity_detection_normalized(spark: SparkSession, d: str) -> DataFrame:
    log = entity_detection(*node_sides(spark, d), "grp", strategy=MatchStrategy.NORMALIZED, threshold=0.85)
    return log.select("grp", "e", "x", "status")


def entity_detection_token(spark: SparkSession, d: str) -> DataFrame:
    """Statuses without the scores of misses, for which only pairs that may
    match are formed."""
    return entity_detection(*worker_sides(spark, d), "grp", miss_scores=False).select("grp", "e", "x", "status")


def entity_match_log(spark: SparkSession, d: str) -> DataFrame:
    return entity_detection(*worker_sides(spark, d), "grp").select("grp", "e", "x", "status", "score", "expected_name", "extracted_name")


def entity_prf1_by_group(spark: SparkSession, d: str) -> DataFrame:
    return prf1(entity_detection(*worker_sides(spark, d), "grp", miss_scores=False), "grp")


def _tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matched nodes of trusted and other origins with their fields."""
    e, x = node_sides(spark, d)
    log = entity_detection(e, x, "grp", strategy=MatchStrategy.NORMALIZED, threshold=0.85).where("status = 'TP'").select("grp", "e", "x")
    left = e.select("grp", F.col("pos").alias("e"), *(F.col(f).alias(f"expected_{f}") for f in FIELDS))
    return log.join(left, ["grp", "e"]).join(x.select("grp", F.col("pos").alias("x"), *(F.col(f).alias(f"extracted_{f}") for f in FIELDS)), ["grp", "x"])


def attribute_eval(spark: SparkSession, d: str) -> DataFrame:
    rows = attributes(_tool_pairs(spark, d), FIELDS)
    return rows.select("grp", "e", "x", "field", "status", F.round("score", 6).alias("score"))


def attribute_status_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = attributes(_tool_pairs(spark, d), FIELDS, explicit=True)
    return rows.groupBy("field", "status").agg(F.count("*").alias("n"))


def relation_detection_query(spark: SparkSession, d: str) -> DataFrame:
    log = relation_detection(*relation_sides(spark, d), "grp", ["before", "after"])
    return log.select("grp", "e", "x", "status", "score")


def relation_log(spark: SparkSession, d: str) -> DataFrame:
    """The whole log of relations, with the names of their players."""
    log = relation_detection(*relation_sides(spark, d), "grp", ["before", "after"])
    return log.select("grp", "e", "x", "status", "score", *(f"{side}_{r}" for side in ("expected", "extracted") for r in ("before", "after")))


def relation_prf1(spark: SparkSession, d: str) -> DataFrame:
    log = relation_detection(*relation_sides(spark, d), "grp", ["before", "after"])
    both = [side.select("grp").distinct() for side in relation_sides(spark, d)]
    # Relation metrics exist only for extractions with relations on both sides.
    return prf1(log.join(both[0], "grp", "left_semi").join(both[1], "grp", "left_semi"), "grp")


def level_eval(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of entities and, for the pairs found, of their attributes, over
    all groups."""
    e, x = node_sides(spark, d)
    log = materialize(entity_detection(e, x, "grp", threshold=0.6, miss_scores=False))
    pairs = level_pairs(log, e, x, "grp", FIELDS)
    whole = log.select(F.lit("entities").alias("category"), "status").unionByName(attributes(pairs, FIELDS).select(F.concat(F.lit("attrs:"), "field").alias("category"), "status"))
    return prf1(whole, "category")


def level_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole level for each graph: metrics of its entities, of the attributes
    of each pair found, and of its relations."""
    e, x = (side.withColumnRenamed("label", "type") for side in node_sides(spark, d))
    out = evaluate_level(e, x, "grp", FIELDS, *relation_sides(spark, d), ["before", "after"], relation_type="ActionOrder")
    parts = {"entity": out["entity_metrics"], "attribute": out["attribute_metrics"], "relation": out["relation_metrics"]}
    columns = ["true_positives", "false_positives", "false_negatives", "precision", "recall", "f1"]
    rows = [m.select(F.lit(k).alias("part"), "grp", (F.col("e") if "e" in m.columns else F.lit(None).cast("bigint")).alias("e"), "category", *columns) for k, m in parts.items()]
    return union_all(rows)


def entity_detection_embedding(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label against those of the next label: which are near?"""
    v = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pos"), "embedding")
    return entity_detection(v.withColumn("label", F.col("label") + 1), v, "label", "embedding", MatchStrategy.EMBEDDING, 0.3).select("label", "e", "x", "status", F.round("score", 3).alias("score"))


def micro_average_query(spark: SparkSession, d: str) -> DataFrame:
    per_site = entity_prf1_by_group(spark, d)
    return micro_average(per_site)


def format_prf1_query(spark: SparkSession, d: str) -> DataFrame:
    counts = entity_prf1_by_group(spark, d).withColumnRenamed("grp", "category")
    return counts.select("category", format_prf1().alias("line"))


def strategy_sweep_query(spark: SparkSession, d: str) -> DataFrame:
    return strategy_sweep(*node_sides(spark, d), "grp")


def prf1_orders(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a guess (large orders are urgent) for each order status."""
    o = table(spark, d, "orders").select("o_orderstatus", (F.col("o_totalprice") > 150000).alias("guess"), F.col("o_orderpriority").startswith("1").alias("truth"))
    counts = o.groupBy("o_orderstatus").agg(
        F.count_if(F.col("guess") & F.col("truth")).alias("true_positives"), F.count_if(F.col("guess") & ~F.col("truth")).alias("false_positives"), F.count_if(~F.col("guess") & F.col("truth")).alias("false_negatives"),
    )
    return with_prf1(counts)


def nested_counts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "video_extractions").dropDuplicates(["extraction_id"]).select("extraction_id", "actions", "tools", "uses_tool")
    return list_sizes(v, "actions", "tools", "uses_tool")


def compare_counts(spark: SparkSession, d: str) -> DataFrame:
    """Actions an extraction lists and those its scenes are observed with."""
    v = table(spark, d, "video_extractions").dropDuplicates(["extraction_id"])
    return compare_sizes(v.select("extraction_id", F.col("actions").alias("items")), v.select("extraction_id", F.col("observed_in_scene").alias("items")), "extraction_id", "items")


def stripped_values(spark: SparkSession, d: str) -> DataFrame:
    return tools(spark, d).select("tool_rec_id", stripped(F.col("manufacturer")).alias("manufacturer"), F.size(tokens(F.coalesce("manufacturer", F.lit("")))).cast("bigint").alias("n"))


QUERIES = {
    "match_exact": match_exact_query, "match_normalized": match_normalized_query, "normalize_name": normalize_name, "strip_blanks": stripped_values, "token_overlap": token_overlap_query,
    "document_tokens": token_overlap_documents, "token_overlap_empty": token_overlap_empty, "token_overlap_join": token_overlap_join, "numeric_compare": numeric_compare,
    "bool_compare": bool_compare, "null_compare": null_compare, "embedding_similarity": embedding_similarity, "entity_detection_normalized": entity_detection_normalized,
    "entity_detection_token": entity_detection_token, "entity_match_log": entity_match_log, "entity_prf1_by_group": entity_prf1_by_group, "attribute_eval": attribute_eval,
    "attribute_status_counts": attribute_status_counts, "relation_detection": relation_detection_query, "relation_log": relation_log, "relation_prf1": relation_prf1, "level_eval": level_eval, "level_run": level_run, "entity_detection_embedding": entity_detection_embedding,
    "micro_average": micro_average_query, "format_prf1": format_prf1_query, "strategy_sweep": strategy_sweep_query, "prf1_orders": prf1_orders, "nested_counts": nested_counts,
    "compare_counts": compare_counts,
}


# The same in SQL, written independently of the operators.
def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{WS}', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{WS}'), lambda w: w <> ''))"


def over(e: str, x: str) -> str:
    return f"(case when len({toks(e)}) = 0 then case when len({toks(x)}) = 0 then 1.0 else 0.0 end else len(list_intersect({toks(e)}, {toks(x)})) / len({toks(e)}) end)"


_TOOLS = "t as (select distinct on (tool_rec_id) * from tools)"
_NODES = f"""
n as (select distinct on (graph_id, ord) graph_id grp, ord pos, name, label, properties['tool_type'] tool_type, properties['manufacturer'] manufacturer, properties['model'] model,
  try_cast(properties['confidence'] as double) confidence, coalesce(origin in ({", ".join(f"'{o}'" for o in TRUSTED)}), false) trusted from nodes),
ex as (select * from n where trusted), xt as (select * from n where not trusted)"""
_WORKERS = """
w as (select distinct on (worker_rec_id) site_code grp, worker_rec_id pos, name, source from workers),
ex as (select * from w where source = 'badge_form'), xt as (select * from w where source <> 'badge_form')"""
_RELATIONS = """
v as (select distinct on (extraction_id) * from video_extractions),
ex as (select extraction_id grp, unnest(range(len(action_order))) pos, unnest(action_order) r from v),
xt as (select extraction_id grp, unnest(range(len(action_causes))) pos, unnest(action_causes) r from v),
ex2 as (select grp, pos, r.before.name a, r."after".name b from ex where r is not null), xt2 as (select grp, pos, r.cause.name a, r.effect.name b from xt where r is not null)"""


def greedy_sql(threshold: float, pairs: str) -> str:
    """Greedy assignment by recursion over the expected records of a group."""
    return f"""
c as ({pairs}),
l as (select grp, e, list({{'s': -score, 'x': x}} order by -score, x) cands, row_number() over (partition by grp order by e) rn from c group by grp, e),
r as (
  select distinct grp, cast(0 as bigint) rn, cast([] as bigint[]) used, cast(null as bigint) e, cast(null as bigint) x, cast(0 as double) score from l
  union all
  select grp, rn, case when -m.s >= {threshold} then list_append(used, m.x) else used end, e, case when -m.s >= {threshold} then m.x end, coalesce(-m.s, 0)
  from (select l.grp, l.rn, r.used, l.e, list_filter(l.cands, lambda z: not list_contains(r.used, z.x))[1] m from r join l on l.grp = r.grp and l.rn = r.rn + 1)),
a as (select * from r where rn > 0)"""


_PAIRS = f"select ex.grp, ex.pos e, xt.pos x, {over('ex.name', 'xt.name')} score from ex join xt using (grp) where {over('ex.name', 'xt.name')} > 0"
_LOG = """
log as (
  select ex.grp, ex.pos e, a.x, case when a.x is null then 'FN' else 'TP' end status, round(coalesce(a.score, 0), 3) score, ex.name expected_name, xt.name extracted_name
  from ex left join a on a.grp = ex.grp and a.e = ex.pos left join xt on xt.grp = a.grp and xt.pos = a.x
  union all
  select grp, null, pos, 'FP', 0, null, name from xt where not exists (select 1 from a where a.grp = xt.grp and a.x = xt.pos))"""
_TOKEN_LOG = f"with recursive {_WORKERS}, {greedy_sql(0.6, _PAIRS)}, {_LOG}"
_KTH = f"""
ek as (select *, {norm('name')} k, row_number() over (partition by grp, {norm('name')} order by pos) i from ex),
xk as (select *, {norm('name')} k, row_number() over (partition by grp, {norm('name')} order by pos) i from xt),
a as (select ek.grp, ek.pos e, xk.pos x, 1.0 score from ek join xk using (grp, k, i))"""


def metrics_sql(source: str, by: str) -> str:
    return f"""select {by}, tp true_positives, fp false_positives, fn false_negatives, round(p, 4) "precision", round(r, 4) recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1, tp + fn total_expected, tp + fp total_extracted
from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end p, case when tp + fn > 0 then tp / (tp + fn) else 0 end r from ({source}))"""


_COUNT = "count(*) filter (status = 'TP') tp, count(*) filter (status = 'FP') fp, count(*) filter (status in ('FN', 'WRONG')) fn"
_BY_SITE = metrics_sql(f"select grp, {_COUNT} from log group by 1", "grp")


def attrs_sql(explicit: bool) -> str:
    """Rows (grp, e, x, field, status, score) of the pairs pr."""
    parts = []
    for f in FIELDS:
        e, x = f"pr.e_{f}", f"pr.x_{f}"
        score = f"case when {e} = 0 then case when {x} = 0 then 1.0 else 0.0 end else greatest(0.0, 1 - abs({e} - {x}) / abs({e})) end" if f == "confidence" else over(e, x)
        parts.append(f"""select grp, e, x, '{f}' field, case when {e} is null and {x} is null then null when {e} is null then {"'FP'" if explicit else "null"} when {x} is null then 'FN' when {score} >= 0.6 then 'TP' else 'WRONG' end status,
  case when {e} is null or {x} is null then 0.0 else {score} end score from pr""")
    return " union all ".join(parts)


_FIELD_PAIRS = f"pr as (select a.grp, a.e, a.x, {', '.join(f'ex.{f} e_{f}, xt.{f} x_{f}' for f in FIELDS)} from a join ex on ex.grp = a.grp and ex.pos = a.e join xt on xt.grp = a.grp and xt.pos = a.x where a.x is not null)"
_ROLE = lambda r: f"(case when ex2.{r} is null and xt2.{r} is null then 1.0 when ex2.{r} is null or xt2.{r} is null then 0.0 else {over(f'ex2.{r}', f'xt2.{r}')} end)"
_REL_PAIRS = f"select * from (select ex2.grp, ex2.pos e, xt2.pos x, ({_ROLE('a')} + {_ROLE('b')}) / 2 score from ex2 join xt2 using (grp)) where score > 0"
_REL_LOG = f"""with recursive {_RELATIONS}, {greedy_sql(0.6, _REL_PAIRS)}, log as (
  select ex2.grp, ex2.pos e, a.x, case when a.x is null then 'FN' else 'TP' end status, round(coalesce(a.score, 0), 3) score, ex2.a expected_before, ex2.b expected_after, xt2.a extracted_before, xt2.b extracted_after
  from ex2 left join a on a.grp = ex2.grp and a.e = ex2.pos left join xt2 on xt2.grp = a.grp and xt2.pos = a.x
  union all select grp, null, pos, 'FP', 0, null, null, a, b from xt2 where not exists (select 1 from a where a.grp = xt2.grp and a.x = xt2.pos))"""
_FIRSTS = ", ".join(f"arg_min({{'v': {f}}}, pos).v {f}" for f in FIELDS)

SQL = {
    "match_exact": f"with {_TOOLS} select tool_rec_id, case when name = tool_type then 1.0::double else 0.0::double end score from t",
    "match_normalized": f"with {_TOOLS} select tool_rec_id, case when {norm('name')} = {norm('tool_type')} then 1.0::double else 0.0::double end score from t",
    "normalize_name": f"with {_TOOLS} select tool_rec_id, 'Tool:' || {norm('name')} node_id from t",
    "strip_blanks": f"with {_TOOLS} select tool_rec_id, regexp_replace(manufacturer, '^{WS}|{WS}$', '', 'g') manufacturer, cast(len({toks(chr(99) + 'oalesce(manufacturer, ' + chr(39) * 2 + ')')}) as bigint) n from t",
    "token_overlap": f"with {_TOOLS} select tool_rec_id, cast(round({over('tool_type', 'name')}, 6) as double) score from t where tool_type is not null and name is not null",
    "document_tokens": f"select doc_id, cast(len({toks('text')}) as bigint) n_tokens, cast(length({norm('text')}) as bigint) n_normal from documents",
    "token_overlap_empty": f"with {_TOOLS}, f as (select tool_rec_id, coalesce(tool_type, ' ') a, coalesce(manufacturer, '') b from t) select tool_rec_id, cast(round({over('a', 'b')}, 6) as double) score from f",
    "token_overlap_join": f"with {_TOOLS}, j as (select maker_id, tool_rec_id, {over('m.name', 't.manufacturer')} score from makers m, t where t.manufacturer is not null) select maker_id, tool_rec_id, cast(round(score, 6) as double) score from j where score >= 0.6",
    "numeric_compare": """
with p as (select distinct on (param_id) param_id, nominal_value e, max_value x from process_parameters),
s as (select param_id, case when e is null and x is null then 1.0 when e is null or x is null then 0.0 when isnan(e) or isnan(x) then 0.0
  when e = 0 then case when x = 0 then 1.0 else 0.0 end else greatest(0.0, 1 - abs(e - x) / abs(e)) end score, e is null and x is null both_null, e is null or x is null one from p)
select param_id, cast(round(score, 9) as double) score, case when both_null then true when one then false else score >= 0.9 end hit, case when one then 'normalized' else 'numeric' end strategy from s""",
    "bool_compare": "select (o_orderstatus = 'F') = (o_orderpriority like '1%') hit, 'exact' strategy, case when o_orderstatus = 'F' then 'True' else 'False' end expected, case when o_orderpriority like '1%' then 'True' else 'False' end extracted, count(*) n from orders group by all",
    "null_compare": f"""with {_TOOLS}, s as (select tool_rec_id, case when model is null and tool_type is null then 1.0 when model is null or tool_type is null then 0.0 else {over('model', 'tool_type')} end score, model is null and tool_type is null both_null, model is null or tool_type is null one from t)
select tool_rec_id, case when both_null then true when one then false else score >= 0.5 end hit, cast(round(score, 6) as double) score, 'token_overlap' strategy from s""",
    "embedding_similarity": """
with e as (select vec_id, cast(embedding as double[]) a, cast(lead(embedding) over (partition by label order by vec_id) as double[]) b from embeddings)
select vec_id, round(greatest(0.0, list_cosine_similarity(a, b)), 6) score from e where b is not null""",
    "entity_detection_normalized": f"with {_NODES}, {_KTH}, {_LOG} select grp, e, x, status from log",
    "entity_detection_token": f"{_TOKEN_LOG} select grp, e, x, status from log",
    "entity_match_log": f"{_TOKEN_LOG} select * from log",
    "entity_prf1_by_group": f"{_TOKEN_LOG} {_BY_SITE}",
    "attribute_eval": f"with {_NODES}, {_KTH}, {_FIELD_PAIRS} select grp, e, x, field, status, cast(round(score, 6) as double) score from ({attrs_sql(False)}) where status is not null",
    "attribute_status_counts": f"with {_NODES}, {_KTH}, {_FIELD_PAIRS} select field, status, count(*) n from ({attrs_sql(True)}) where status is not null group by all",
    "relation_detection": f"{_REL_LOG} select grp, e, x, status, score from log",
    "relation_log": f"{_REL_LOG} select * from log",
    "relation_prf1": f"{_REL_LOG}, kept as (select * from log where grp in (select grp from ex2) and grp in (select grp from xt2)) {metrics_sql(f'select grp, {_COUNT} from kept group by 1', 'grp')}",
    "level_eval": f"""with recursive {_NODES}, {greedy_sql(0.6, _PAIRS)}, {_LOG},
fe as (select grp, name, {_FIRSTS} from ex group by all), fx as (select grp, name, {_FIRSTS} from xt group by all),
pr as (select log.grp, log.e, log.x, {', '.join(f'fe.{f} e_{f}, fx.{f} x_{f}' for f in FIELDS)} from log join fe on fe.grp = log.grp and fe.name = expected_name join fx on fx.grp = log.grp and fx.name = extracted_name where status = 'TP'),
whole as (select 'entities' category, status from log union all select 'attrs:' || field, status from ({attrs_sql(False)}) where status is not null)
{metrics_sql(f'select category, {_COUNT} from whole group by 1', 'category')}""",
    "level_run": f"""with recursive {_NODES}, {greedy_sql(0.6, _PAIRS)}, {_LOG},
fe as (select grp, name, {_FIRSTS} from ex group by all), fx as (select grp, name, {_FIRSTS} from xt group by all),
pr as (select log.grp, log.e, log.x, expected_name, {', '.join(f'fe.{f} e_{f}, fx.{f} x_{f}' for f in FIELDS)} from log join fe on fe.grp = log.grp and fe.name = expected_name join fx on fx.grp = log.grp and fx.name = extracted_name where status = 'TP'),
kinds as (select grp, arg_min(label, pos) label from ex group by 1),
ent as (select 'entity' part, log.grp, cast(null as bigint) e, coalesce(label, 'Unknown') category, {_COUNT} from log left join kinds using (grp) group by all),
att as (select 'attribute' part, a.grp, a.e, 'attrs:' || coalesce(pr.expected_name, 'None') category, {_COUNT} from ({attrs_sql(False)}) a join pr on pr.grp = a.grp and pr.e = a.e where status is not null group by all),
{_RELATIONS.replace('ex as', 'rex as').replace('xt as', 'rxt as').replace('from ex where', 'from rex where').replace('from xt where', 'from rxt where')},
{greedy_sql(0.6, _REL_PAIRS).replace('c as (', 'rc as (', 1).replace('l as (select', 'rl as (select', 1).replace('from c group', 'from rc group').replace('r as (', 'rr as (', 1).replace('from l', 'from rl').replace('from r join l on l.grp = r.grp and l.rn = r.rn + 1', 'from rr r join rl l on l.grp = r.grp and l.rn = r.rn + 1').replace('a as (select * from r ', 'ra as (select * from rr ')},
rlog as (select ex2.grp, case when ra.x is null then 'FN' else 'TP' end status from ex2 left join ra on ra.grp = ex2.grp and ra.e = ex2.pos
  union all select grp, 'FP' from xt2 where not exists (select 1 from ra where ra.grp = xt2.grp and ra.x = xt2.pos)),
rel as (select 'relation' part, grp, cast(null as bigint) e, 'ActionOrder' category, {_COUNT} from rlog where grp in (select grp from ex2) and grp in (select grp from xt2) group by all)
select part, grp, e, category, true_positives, false_positives, false_negatives, "precision", recall, f1 from ({metrics_sql('select * from ent union all select * from att union all select * from rel', 'part, grp, e, category')})""",
    "entity_detection_embedding": f"""with recursive v as (select label grp, vec_id pos, cast(embedding as double[]) name from embeddings), ex as (select grp + 1 grp, pos, name from v), xt as (select * from v),
{greedy_sql(0.3, "select * from (select ex.grp, ex.pos e, xt.pos x, greatest(0.0, list_cosine_similarity(ex.name, xt.name)) score from ex join xt using (grp)) where score > 0")},
log as (select ex.grp, ex.pos e, a.x, case when a.x is null then 'FN' else 'TP' end status, round(coalesce(a.score, 0), 3) score from ex left join a on a.grp = ex.grp and a.e = ex.pos
  union all select grp, null, pos, 'FP', 0 from xt where not exists (select 1 from a where a.grp = xt.grp and a.x = xt.pos))
select grp "label", e, x, status, score from log""",
    "micro_average": f"{_TOKEN_LOG} {metrics_sql(f'select {_COUNT} from log', chr(39) + 'overall' + chr(39) + ' category')}",
    "format_prf1": f"""{_TOKEN_LOG}, m as ({_BY_SITE})
select grp category, printf('%-30s | P=%.3f R=%.3f F1=%.3f | TP=%d FP=%d FN=%d', grp, "precision", recall, f1, true_positives, false_positives, false_negatives) line from m""",
    "strategy_sweep": f"""with recursive {_NODES}, {greedy_sql(0.6, _PAIRS)}, s as (
  select 'token_overlap' strategy, (select count(*) from a where x is not null) tp
  union all select 'normalized', sum(least(p, q)) from (select grp, {norm('name')} k, count(*) filter (trusted) p, count(*) filter (not trusted) q from n group by all)
  union all select 'exact', sum(least(p, q)) from (select grp, name, count(*) filter (trusted) p, count(*) filter (not trusted) q from n group by all)),
m as (select strategy, cast(tp as bigint) tp, (select count(*) from xt) - cast(tp as bigint) fp, (select count(*) from ex) - cast(tp as bigint) fn from s)
{metrics_sql('select * from m', 'strategy')}""",
    "prf1_orders": metrics_sql("select o_orderstatus, count(*) filter (o_totalprice > 150000 and o_orderpriority like '1%') tp, count(*) filter (o_totalprice > 150000 and o_orderpriority not like '1%') fp, count(*) filter (o_totalprice <= 150000 and o_orderpriority like '1%') fn from orders group by 1", "o_orderstatus"),
    "nested_counts": "select distinct on (extraction_id) extraction_id, cast(coalesce(len(actions), 0) as int) n_actions, cast(coalesce(len(tools), 0) as int) n_tools, cast(coalesce(len(uses_tool), 0) as int) n_uses_tool from video_extractions",
    "compare_counts": "select distinct on (extraction_id) extraction_id, cast(coalesce(len(actions), 0) as int) expected_items, cast(coalesce(len(observed_in_scene), 0) as int) got_items, coalesce(len(actions), 0) = coalesce(len(observed_in_scene), 0) same_items from video_extractions",
}
