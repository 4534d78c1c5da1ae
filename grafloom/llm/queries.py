"""Named queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal
from ..session import materialize
from ..sources.tables import table
from .mixing import mix
from .names import maker_matches, person_clusters
from .packing import fill_report, pack
from .spans import linked_pairs, shared_amount, shared_spans
from .split import parse_strategy, split_texts
from .survivor import NOTHING, current_fields, surviving_fields
from .tokens import token_counts


def _over(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that exceed what their run's strategy allows."""

    def sizes(batches):
        for pdf in batches:
            pdf["size"], pdf["overlap"] = zip(*map(parse_strategy, pdf.pop("chunking_strategy"))) if len(pdf) else ([], [])
            yield pdf.astype({"size": "Int64", "overlap": "Int64"})

    runs = table(spark, d, "experiment_runs").select("run_id", "chunking_strategy").where("run_id is not null").dropDuplicates(["run_id"])
    runs = runs.mapInPandas(sizes, "run_id int, size int, overlap int").where("size is not null")
    results = table(spark, d, "extraction_results").select("result_id", "run_id", "source_chunk").join(runs, "run_id")
    # Only what must be split is moved to find what was delivered again.
    return results.where(F.length("source_chunk") > F.col("size")).dropDuplicates(["result_id"])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(_over(spark, d), "result_id", "source_chunk", "size", "overlap")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece = 0").select("result_id", "hard")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each result: none over the limit, each
    begins the stated overlap before the end of the one before it, together they
    give the text."""
    at = Window.partitionBy("result_id").orderBy("piece")
    rows = _pieces(spark, d).join(_over(spark, d).select("result_id", "size", "overlap"), "result_id")
    rows = rows.withColumn("from", F.coalesce(F.lag("end").over(at), F.lit(0)))
    return rows.groupBy("result_id").agg(
        F.count_if(F.col("end") - F.col("start") > F.col("size")).alias("n_over"), F.count_if((F.col("piece") > 0) & (F.col("start") != F.greatest(F.col("from") - F.col("overlap"), F.lit(0)))).alias("n_unlike_overlap"),
        F.sum(F.col("end") - F.col("from")).alias("n_chars"), F.md5(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("piece", F.expr("substr(text, `from` - start + 1)").alias("own")))), lambda x: x["own"]))).alias("text_md5"),
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Tool and node records with their fields as a map."""
    tools = table(spark, d, "tools").select(
        F.lit("Tool").alias("record"), F.col("tool_id").alias("group_key"), F.col("tool_rec_id").alias("rec"),
        F.create_map(F.lit("model"), "model", F.lit("tool_type"), "tool_type").alias("fields"), "origin", "observed_at",
    )
    nodes = table(spark, d, "nodes").select(
        F.lit("GraphNode").alias("record"), F.concat(F.col("graph_id").cast("string"), F.lit("|"), "label", F.lit(":"), normal(F.col("name"))).alias("group_key"),
        F.col("ord").alias("rec"), F.col("properties").alias("fields"), "origin", "observed_at",
    )
    return tools.unionByName(nodes)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d).join(table(spark, d, "source_trust"), "origin", "left")
    return surviving_fields(rows, ["record", "group_key"], "rec", "fields", "trust_rank", "observed_at")


def p5_current(spark: SparkSession, d: str) -> DataFrame:
    """The latest value of each field by learned currency alone, beside the one
    that the hidden times tell."""
    return current_fields(_records(spark, d), ["record", "group_key"], "rec", "fields", "observed_at")


def _persons(spark: SparkSession, d: str) -> DataFrame:
    return person_clusters(table(spark, d, "workers"), "worker_rec_id", "site_code", "name")


def _makers(spark: SparkSession, d: str) -> DataFrame:
    return maker_matches(table(spark, d, "tools"), "tool_rec_id", "manufacturer", table(spark, d, "makers"), "maker_id", "name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    persons = _persons(spark, d)
    a, b = (persons.select("site_code", "person", F.col("worker_rec_id").alias(c)) for c in ("key_a", "key_b"))
    workers = a.join(b, ["site_code", "person"]).where("key_a < key_b").select(F.lit("Worker").alias("kind"), "key_a", "key_b")
    makers = _makers(spark, d).where("not exact").select(F.lit("Manufacturer").alias("kind"), F.col("tool_rec_id").alias("key_a"), F.col("maker_id").alias("key_b"))
    return workers.unionByName(makers)


def p6_persons(spark: SparkSession, d: str) -> DataFrame:
    """The person of each worker record, without expanding groups to pairs."""
    return _persons(spark, d)


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[int, int]]:
    # A fixed table: one row for each kind of container.
    capacities = {r["container_kind"]: r["capacity_tokens"] for r in table(spark, d, "containers").collect()}
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text")
    return pack(sizes, "doc_id", "n_tokens", capacities), capacities


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(*_packed(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers of each kind: none holds more than its
    capacity, no piece begins before the end of the one before it, no document
    is placed twice."""
    packed, capacities = _packed(spark, d)
    placed = materialize(packed.where("container is not null"))
    capacity = F.create_map(*(F.lit(x) for pair in capacities.items() for x in pair))[F.col("container_kind")]
    at = Window.partitionBy("container_kind", "container").orderBy("position")
    ends = placed.withColumn("last", F.lag(F.col("position") + F.col("n_tokens")).over(at)).groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("t"), F.max(F.col("position") + F.col("n_tokens")).alias("z"), F.count_if(F.col("position") < F.col("last")).alias("o"))
    kinds = ends.groupBy("container_kind").agg(F.count_if((F.col("t") > capacity) | (F.col("z") > capacity)).alias("n_overfull"), F.sum("o").alias("n_overlapping"))
    twice = placed.groupBy("doc_id", "piece").agg(F.min("container_kind").alias("container_kind"), F.count("*").alias("n")).groupBy("container_kind").agg(F.count_if(F.col("n") > 1).alias("n_twice"))
    return kinds.join(twice, "container_kind")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_counts(table(spark, d, "documents"), "doc_id", "text", "source")
    return mix(sizes, "doc_id", "source", "n_tokens", table(spark, d, "mix_targets"))


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source: every document has one row, none is used
    more often than allowed, and no two differ in use by more than one."""
    use, _ = _mixed(spark, d)
    goals = table(spark, d, "mix_targets").select("source", "max_repeats")
    used = F.when(F.col("n_tokens") > 0, F.col("copies"))
    rows = use.join(goals, "source", "left").groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("copies") > F.coalesce("max_repeats", F.lit(0))).alias("n_beyond"), (F.coalesce(F.max(used) - F.min(used), F.lit(0)) > 1).alias("uneven"))
    return rows


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    links, members, _ = shared_spans(table(spark, d, "documents"), "doc_id", "text")
    return linked_pairs(links, members)


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    _, members, spans = shared_spans(docs, "doc_id", "text")
    return shared_amount(docs, "doc_id", "text", members, spans)


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_check": p2_check, "p5_found": p5_found, "p5_current": p5_current, "p6_found": p6_found, "p6_persons": p6_persons, "p7_containers": p7_containers, "p7_fill": p7_fill, "p7_check": p7_check, "p8_copies": p8_copies, "p8_shares": p8_shares, "p8_check": p8_check, "p9_found": p9_found, "p9_shared": p9_shared}

_NOTHING = ", ".join(f"'{x}'" for x in NOTHING)
_BLANKS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0]+"

#: Every window of 200 characters of every text, and those that stand in more than one document.
_WINDOWS = """
t as (select distinct doc_id, text from documents where length(text) >= 200),
w as (select doc_id, i, md5(substr(text, i + 1, 200)) h from (select doc_id, text, unnest(range(length(text) - 199)) i from t)),
s as (select h from w group by h having min(doc_id) < max(doc_id)), k as (select distinct w.* from w join s using (h))"""

SQL = {
    "p7_check": "select container_kind, 0::bigint n_overfull, 0::bigint n_overlapping, 0::bigint n_twice from containers",
    "p8_check": "select source, count(distinct doc_id) n_documents, 0::bigint n_beyond, false uneven from documents group by 1",
    "p9_found": f"with {_WINDOWS}, d as (select distinct h, doc_id from k) select distinct a.doc_id doc_a, b.doc_id doc_b from d a join d b on a.h = b.h and a.doc_id < b.doc_id",
    "p9_shared": f"""with {_WINDOWS}, g as (select doc_id, lead(i) over (partition by doc_id order by i) - i gap from k),
c as (select doc_id, count(*) filter (gap is null or gap > 200) n_spans, cast(sum(least(coalesce(gap, 200), 200)) as bigint) shared_chars from g group by 1),
n as (select doc_id, max(coalesce(length(text), 0)) n_chars from documents group by 1)
select doc_id, n_chars, coalesce(n_spans, 0) n_spans, coalesce(shared_chars, 0) shared_chars, case when n_chars > 0 then coalesce(shared_chars, 0) / n_chars else 0.0 end shared_part from n left join c using (doc_id)""",
    "p2_found": r"""
with sizes as (
  select run_id, unnest(regexp_extract_all(chunking_strategy, '\d+(?:[.]\d+)?\s*[k%]?')) x from (select distinct on (run_id) * from experiment_runs)),
limits as (
  select run_id, max(cast(regexp_extract(x, '[0-9.]+') as double) * case when x like '%k' then 1000 else 1 end) size from sizes where x not like '%\%' escape '\' group by 1),
r as (select distinct on (result_id) result_id, run_id, source_chunk from extraction_results)
select result_id, case when list_max(list_transform(regexp_split_to_array(source_chunk, '\s+'), lambda w: length(w))) > size then 1 else 0 end hard
from r join limits using (run_id) where length(source_chunk) > size""",
    "p2_check": r"""
with sizes as (
  select run_id, unnest(regexp_extract_all(chunking_strategy, '\d+(?:[.]\d+)?\s*[k%]?')) x from (select distinct on (run_id) * from experiment_runs)),
limits as (
  select run_id, max(cast(regexp_extract(x, '[0-9.]+') as double) * case when x like '%k' then 1000 else 1 end) size from sizes where x not like '%\%' escape '\' group by 1),
r as (select distinct on (result_id) result_id, run_id, source_chunk from extraction_results)
select result_id, 0::bigint n_over, 0::bigint n_unlike_overlap, length(source_chunk) n_chars, md5(source_chunk) text_md5 from r join limits using (run_id) where length(source_chunk) > size""",
    "p5_found": f"""
with r as (
  select 'Tool' record, tool_id group_key, tool_rec_id rec, origin, observed_at, unnest(['model', 'tool_type']) field, unnest([model, tool_type]) value from tools
  union all
  select 'GraphNode', graph_id || '|' || label || ':' || trim(regexp_replace(lower(name), '{_BLANKS}', ' ', 'g')), ord, origin, observed_at, unnest(map_keys(properties)), unnest(map_values(properties)) from nodes),
ids as (
  select 'Tool' record, tool_id group_key from tools group by all having count(distinct tool_rec_id) > 1
  union all
  select 'GraphNode', graph_id || '|' || label || ':' || trim(regexp_replace(lower(name), '{_BLANKS}', ' ', 'g')) from nodes group by all having count(distinct ord) > 1),
v as (select record, group_key, field, regexp_replace(value, '^{_BLANKS}|{_BLANKS}$', '', 'g') v, trust_rank, observed_at
  from r join ids using (record, group_key) left join source_trust using (origin))
select record, group_key, field, arg_max(v, (coalesce(-trust_rank, -1000), observed_at)) "value" from v
where regexp_matches(v, '[\\p{{L}}\\p{{N}}]') and lower(v) not in ({_NOTHING}) group by all""",
}
