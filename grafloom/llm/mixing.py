"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import salt

SALTS = 64


def mix_rates(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> tuple[float, dict[str, float]]:
    """Total size and the expected copies of each document of each source.

    Without a given total it is the largest at which every source that has
    tokens reaches its share within its repeats. With a larger total the scarce
    sources give what they may, and stay below their share.
    """
    usable = {s: (share, repeats) for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and tokens.get(s, 0) > 0}
    whole = sum(share for share, _ in usable.values())
    if not usable:
        return 0.0, {}
    if total is None:
        total = min(repeats * tokens[s] * whole / share for s, (share, repeats) in usable.items())
    return total, {s: min(float(repeats), total * share / whole / tokens[s]) for s, (share, repeats) in usable.items()}


def mix(docs: DataFrame, item: str, source: str, size: str, targets: DataFrame, *, target_source: str = "source", share: str = "target_share", max_repeats: str = "max_repeats", total: float | None = None, seed: int = 0, salts: int = SALTS) -> tuple[DataFrame, DataFrame]:
    """How often each document is used, and the shares that result.

    Systematic sampling: the documents of a source are put in order of size,
    their expected copies are summed up along it, one random offset is added,
    and a document is used once for each integer that the sum passes in it. So
    a document is used floor(r) or ceil(r) times, r being the expected copies
    (target tokens / tokens of the source, at most max_repeats), and documents
    of all sizes are used alike, which keeps the tokens near the target.

    docs      one row for each item (a repeated row counts once); size in tokens
    targets   one row for each source: share of all tokens (scaled to sum to 1
              over the sources that have tokens), and how often it may be used
    returns   use (item, source, n_tokens, copies) of every document, and report
              (source, target_share, max_repeats, documents, tokens,
              expected_copies, used_tokens, actual_share) of every source

    Documents whose source is null or has no target, and those without tokens,
    are used 0 times; the report has their source with a null target. The
    offset of a source depends on seed and its name alone.

    The targets (one row a source, a small table by definition) and one sum a
    target go to the driver. A source may hold any share of the rows: its
    documents are numbered in parts by size and salt, whose counts are summed.
    """
    rows = docs.select(F.col(item).alias("item"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).dropDuplicates(["item"])
    rows = materialize(rows.withColumns({"part": F.when(F.col("n") > 0, F.floor(F.log2("n") * 8)).otherwise(-1).cast("int"), "salt": salt("item", salts)}))
    goals = targets.select(F.col(target_source).alias("source"), F.col(share).cast("double").alias("target_share"), F.col(max_repeats).cast("int").alias("max_repeats")).where("source is not null").dropDuplicates(["source"])
    sums = rows.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("documents"))
    known = goals.join(sums, "source", "left").collect()
    _, rates = mix_rates({r["source"]: r["tokens"] or 0 for r in known}, {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in known}, total)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, r, xxhash.xxh3_64_intdigest(f"{seed}:{s}".encode()) / 2**64) for s, r in rates.items()], "source string, rate double, offset double")
    used = rows.where("part >= 0").join(plan, "source")
    parts = used.groupBy("source", "part", "salt").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("source", "part", "salt").orderBy("n", "item")) - 1 + F.col("before")
    numbered = used.join(parts.select("source", "part", "salt", before.alias("before")), ["source", "part", "salt"]).withColumn("place", place)
    passed = F.floor((F.col("place") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("place") * F.col("rate") + F.col("offset"))
    rest = rows.join(plan, "source", "left").where("part < 0 or rate is null").select("item", "source", "n", F.lit(0).cast("bigint").alias("copies"))
    use = materialize(numbered.select("item", "source", "n", passed.cast("bigint").alias("copies")).unionByName(rest))
    by_source = use.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum(F.col("n") * F.col("copies")).alias("used_tokens"))
    report = by_source.join(plan.select("source", "rate"), "source", "left").join(goals, "source", "left")
    report = report.withColumn("all_tokens", F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))  # one row a source
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "tokens", F.coalesce("rate", F.lit(0.0)).alias("expected_copies"), "used_tokens",
        F.when(F.col("all_tokens") > 0, F.col("used_tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
    )
    return use.select(F.col("item").alias(item), F.col("source").alias(source), F.col("n").alias(size), "copies"), report
