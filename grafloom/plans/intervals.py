"""Queries on the time of actions and scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import HOUR_MS, periods_and_gaps, whole_ms
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "timed_entities").select(
        "video_id", "entity_type", whole_ms(F.col("timestamp_start_seconds")).alias("s"), whole_ms(F.col("timestamp_end_seconds")).alias("e")
    )
    found = periods_and_gaps(rows, ["video_id", "entity_type"], "s", "e")
    return found.where((F.col("kind") == "period") | (F.col("end") - F.col("start") < HOUR_MS)).select(
        "video_id", "entity_type", "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms")
    )


QUERIES = {"p1_found": p1_found}

SQL = {
    "p1_found": """
with i as (
  select video_id, entity_type, cast(round(timestamp_start_seconds * 1000) as bigint) s, cast(round(timestamp_end_seconds * 1000) as bigint) e
  from timed_entities where isfinite(timestamp_start_seconds) and isfinite(timestamp_end_seconds)),
m as (select *, max(e) over (partition by video_id, entity_type order by s, e rows between unbounded preceding and 1 preceding) p from i where e > s),
g as (select *, sum(case when p is null or s > p then 1 else 0 end) over (partition by video_id, entity_type order by s, e rows unbounded preceding) n from m),
periods as (select video_id, entity_type, n, min(s) a, max(e) z from g group by all),
gaps as (select video_id, entity_type, z a, lead(a) over (partition by video_id, entity_type order by n) z from periods)
select video_id, entity_type, 'period' kind, a start_ms, z end_ms from periods
union all select video_id, entity_type, 'gap', a, z from gaps where z - a < 3600000""",
}
