"""Experiment runs and their metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import MatchStrategy
from ..functions.metrics import prf1
from .evaluate import entity_detection
from .graph import union_all


def record_run(runs: DataFrame, metrics: dict[str, DataFrame], *values: str) -> DataFrame:
    """runs with a map column for each kind of metric (entity_metrics, ...):
    category to F1, or with values to a struct of these columns; kinds without
    a metric of a run are null."""
    out = runs
    for kind, m in metrics.items():
        value = F.struct(*values).alias("m") if values else F.col("f1")
        packed = m.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", value)))).alias(f"{kind}_metrics"))
        out = out.join(packed, "run_id", "left")
    return out


def append_run(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def strategy_sweep(expected: DataFrame, extracted: DataFrame, group: str, threshold: float = 0.6, strategies: tuple[str, ...] = ("exact", "normalized", "token_overlap"), name: str = "name") -> DataFrame:
    """Metrics of the same records under each strategy, over all groups."""
    logs = [entity_detection(expected, extracted, group, name, MatchStrategy(s), threshold, miss_scores=False).select("status").withColumn("strategy", F.lit(s)) for s in strategies]
    return prf1(union_all(logs), "strategy")


def list_sizes(df: DataFrame, *columns: str) -> DataFrame:
    """Sizes of list columns; a null list counts as empty."""
    return df.select(*(c for c in df.columns if c not in columns), *(F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).alias(f"n_{c}") for c in columns))


def compare_sizes(expected: DataFrame, extracted: DataFrame, key: str, *columns: str) -> DataFrame:
    """Sizes of both sides by key, and whether they are equal."""
    e, x = (list_sizes(d.select(key, *columns), *columns) for d in (expected, extracted))
    both = e.select(key, *(F.col(f"n_{c}").alias(f"expected_{c}") for c in columns)).join(x.select(key, *(F.col(f"n_{c}").alias(f"got_{c}") for c in columns)), key, "full")
    return both.select(key, *(x for c in columns for x in (f"expected_{c}", f"got_{c}", F.col(f"expected_{c}").eqNullSafe(F.col(f"got_{c}")).alias(f"same_{c}"))))


def compare_executions(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Executed procedures of both sides by key (columns key and record, of the
    declared type): sizes of their four lists and whether they are equal, and
    supervisor, status and result side by side."""
    lists = ["step_executions", "quality_checks", "feedback", "executed_by"]
    shown = {"supervised_by": "record.supervised_by.name", "overall_status": "record.overall_status", "overall_result": "record.overall_result"}
    sizes = compare_sizes(*(d.select(key, *(F.col(f"record.{c}").alias(c) for c in lists)) for d in (expected, got)), key, *lists)
    for side, d in (("expected", expected), ("got", got)):
        sizes = sizes.join(d.select(key, *(F.col(path).alias(f"{side}_{c}") for c, path in shown.items())), key, "left")
    return sizes


def flatten_execution(df: DataFrame, key: str) -> DataFrame:
    """(key, part, pos, name, status, detail): steps, checks and feedback of
    executed procedures (columns key and record) as rows. A step has its name,
    status and duration; a check its inspector, result and findings; feedback
    who gave it, its type and content. Missing lists and null elements give no
    row."""
    parts = {
        "step": ("step_executions", lambda x: (x["step"]["name"], x["status"], x["actual_duration_seconds"].cast("string"))),
        "check": ("quality_checks", lambda x: (x["inspector"]["name"], x["result"], x["findings"])),
        "feedback": ("feedback", lambda x: (x["reported_by"]["name"], x["feedback_type"], x["content"])),
    }

    def rows(part: str) -> Column:
        column, shown = parts[part]
        one = lambda x, i: F.when(x.isNotNull(), F.struct(F.lit(part).alias("part"), i.alias("pos"), *(v.alias(n) for n, v in zip(("name", "status", "detail"), shown(x)))))
        return F.coalesce(F.filter(F.transform(F.col(f"record.{column}"), one), lambda x: x.isNotNull()), F.array().cast("array<struct<part:string,pos:int,name:string,status:string,detail:string>>"))

    return df.select(key, F.explode(F.concat(*map(rows, parts))).alias("_p")).select(key, "_p.*")
