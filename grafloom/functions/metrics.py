"""Precision, recall and F1 from counts, as columns and as text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ["true_positives", "false_positives", "false_negatives"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)


def with_prf1(df: DataFrame, digits: int = 4, python_rounding: bool = False) -> DataFrame:
    """Adds precision, recall, f1 and the totals to the three counts. F1 comes
    from unrounded values; zero denominators give 0. Rounding is decimal half
    up, or of the binary value (as Python rounds) on demand."""
    tp, fp, fn = map(F.col, COUNTS)
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    out = df.withColumns({"precision": p, "recall": r, "f1": _ratio(F.lit(2.0) * p * r, p + r), "total_expected": tp + fn, "total_extracted": tp + fp})
    ratios = ["precision", "recall", "f1"]
    if not python_rounding:
        return out.withColumns({c: F.round(c, digits) for c in ratios})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in ratios:
                pdf[c] = [round(x, digits) for x in pdf[c]]
            yield pdf

    return out.mapInPandas(run, out.schema)


def prf1(log: DataFrame, *by: str, status: str = "status") -> DataFrame:
    """Counts of the statuses TP, FP and FN (also WRONG) of a match log, for
    each value of by, with their metrics."""
    s = F.col(status)
    counts = log.groupBy(*by).agg(F.count_if(s == "TP").alias(COUNTS[0]), F.count_if(s == "FP").alias(COUNTS[1]), F.count_if(s.isin("FN", "WRONG")).alias(COUNTS[2]))
    return with_prf1(counts)


def micro_average(metrics: DataFrame, category: str = "overall") -> DataFrame:
    """One row of the summed counts; of no rows, zeros."""
    return with_prf1(metrics.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).select(F.lit(category).alias("category"), *COUNTS))


@F.pandas_udf(T.StringType())
def _line(category: pd.Series, p: pd.Series, r: pd.Series, f: pd.Series, tp: pd.Series, fp: pd.Series, fn: pd.Series) -> pd.Series:
    return pd.Series([f"{c:30s} | P={x:.3f} R={y:.3f} F1={z:.3f} | TP={i} FP={j} FN={k}" for c, x, y, z, i, j, k in zip(category, p, r, f, tp, fp, fn)])


def format_prf1() -> Column:
    """One metric row as a line of text. Python writes it, since Java rounds
    the decimal form, not the binary value; metric tables are small."""
    return _line("category", "precision", "recall", "f1", *COUNTS)


@F.pandas_udf(T.StringType())
def _row(category: pd.Series, p: pd.Series, r: pd.Series, f: pd.Series, tp: pd.Series, fp: pd.Series, fn: pd.Series) -> pd.Series:
    return pd.Series([f"{c:30s} | {x:6.3f} {y:6.3f} {z:6.3f} | {i:3d} {j:3d} {k:3d}" for c, x, y, z, i, j, k in zip(category, p, r, f, tp, fp, fn)])


def format_prf1_table(metrics: DataFrame, title: str = "Evaluation Results", order: str = "category") -> str:
    """A metric table, a small one by nature, as text with rules and a header;
    its rows in the order of a column."""
    rule = "=" * 80
    head = f"{'Category':30s} | {'P':>6s} {'R':>6s} {'F1':>6s} | {'TP':>3s} {'FP':>3s} {'FN':>3s}"
    lines = [r[0] for r in metrics.orderBy(order).select(_row("category", "precision", "recall", "f1", *COUNTS)).collect()]
    return "\n".join(["", rule, f"  {title}", rule, head, "-" * 80, *lines, rule])
