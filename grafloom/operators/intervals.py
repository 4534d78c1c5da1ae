"""Overlapping and gapped intervals: continuous periods and the gaps between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

HOUR_MS = 3_600_000


def whole_ms(seconds: Column) -> Column:
    """Seconds as whole milliseconds; null if missing, not a number, infinite or
    beyond what a 64-bit count of milliseconds holds."""
    return F.round(seconds * F.lit(1000.0)).try_cast("bigint")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, *, slice_width: int = HOUR_MS) -> DataFrame:
    """Periods covered without interruption and the gaps between, for each key.

    Starts and ends are ranked independently within a key. After the i-th end
    there is a gap exactly if the start of rank i + 1 is later. Starts behind a
    gap and ends before one alternate; each paired with the next of the other
    kind gives a period or a gap. Touching intervals continue a period.

    One key may hold any share of the rows: the axis is cut into slices, ranks
    are counted within a slice, to which the counts of earlier slices are added
    (one summary row a slice crosses over). Ranks that are to be compared and
    lie in different slices need no look at the times: the later slice is later.
    So the boundaries are moved once.

    df        keys, and the bigint columns start and end
    returns   keys, kind ('period' or 'gap'), start, end

    Rows with a null bound or an end not after the start are no intervals.
    Repeated rows change nothing; null keys form keys of their own; an empty
    input gives an empty result. Other columns are ignored.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(c).alias(n) for c, n in zip(keys, k)), F.col(start).alias("_s"), F.col(end).alias("_e")).where("_e > _s")
    ends = F.array(*(F.struct(F.col(c).alias("t"), F.lit(is_end).alias("end")) for c, is_end in (("_s", False), ("_e", True))))
    bounds = rows.select(*k, F.explode(ends).alias("_v")).select(*k, F.floor(F.col("_v.t") / F.lit(slice_width)).cast("bigint").alias("_b"), "_v.t", "_v.end")
    # Of each slice, the numbers of starts and of ends, and of those before it.
    earlier = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c)
    counted = bounds.groupBy(*k, "_b").agg(F.count_if(~F.col("end")).alias("_ns"), F.count_if("end").alias("_ne")).select(*k, "_b", before("_ns"), before("_ne"), F.col("_ns").alias("_ms"), F.col("_ne").alias("_me"))
    # A slice's summary comes as a row in front of its bounds.
    head = counted.select(*k, "_b", F.lit(None).cast("bigint").alias("t"), F.lit(None).cast("boolean").alias("end"), F.struct("_ns", "_ne", "_ms", "_me").alias("_c"))
    together = head.unionByName(bounds, allowMissingColumns=True)
    own = Window.partitionBy(*k, "_b").orderBy(F.asc_nulls_first("end"), "t").rowsBetween(Window.unboundedPreceding, 0)
    ranked = together.withColumns({"_c": F.first("_c", ignorenulls=True).over(own), "_n": F.count("*").over(own) - 1}).where("t is not null")
    ranked = ranked.withColumn("_rank", F.when(F.col("end"), F.col("_n") - F.col("_c._ms")).otherwise(F.col("_n")))
    # i: the rank of an end, and of the end that a start of rank i + 1 follows.
    ranked = ranked.withColumn("_i", F.when(F.col("end"), F.col("_rank") + F.col("_c._ne")).otherwise(F.col("_rank") + F.col("_c._ns") - 1))
    ahead = Window.partitionBy(*k, "_b").orderBy("_i", "end")
    pair = {"_before": F.lag(F.struct("_i", "t", "end")).over(ahead), "_after": F.lead(F.struct("_i", "t", "end")).over(ahead)}
    met = ranked.withColumns(pair)
    # Sorted by i, a start stands just before the end it may follow.
    first, last = (F.col(f"_c.{a}") + F.col(f"_c.{b}") for a, b in (("_ne", "_me"), ("_ns", "_ms")))
    opens = F.when(F.col("_i") <= F.col("_c._ne"), True).when(F.col("_i") > first, False).otherwise(F.col("t") > F.col("_after.t"))
    closes = F.when(F.col("_i") + 1 <= F.col("_c._ns"), False).when(F.col("_i") + 1 > last, True).otherwise(F.col("_before.t") > F.col("t"))
    edges = materialize(met.where(F.when(F.col("end"), closes).otherwise(opens)).select(*k, "_b", "t", "end"))  # read twice below
    inside = edges.withColumn("_next", F.lead("t").over(Window.partitionBy(*k, "_b").orderBy("t", "end")))
    firsts = edges.groupBy(*k, "_b").agg(F.min("t").alias("_f")).select(*k, "_b", F.lead("_f").over(Window.partitionBy(*k).orderBy("_b")).alias("_f"))
    firsts = firsts.select(*(F.col(c).alias(f"r{c}") for c in [*k, "_b"]), "_f")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"r{c}")) for c in [*k, "_b"]))
    return (
        inside.join(firsts, same, "left").withColumn("_next", F.coalesce("_next", "_f")).where("_next is not null")
        .select(*(F.col(n).alias(c) for c, n in zip(keys, k)), F.when(F.col("end"), "gap").otherwise("period").alias("kind"), F.col("t").alias("start"), F.col("_next").alias("end"))
    )
