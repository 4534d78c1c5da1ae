"""Filling containers of several fixed capacities with texts."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import salt

#: Parts in which the items of one size are numbered.
SALTS = 64
#: Capacity of a group of containers that is used together.
STEP_TOKENS = 32_768


class _Bins:
    """Groups of equally filled containers of one tier, by what is free in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first container, containers)
        self.gaps: list[int] = []

    def put(self, gap: int, first: int, n: int) -> None:
        if not self.by_gap[gap]:
            insort(self.gaps, gap)
        self.by_gap[gap].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The group with the smallest gap of at least least."""
        i = bisect_left(self.gaps, least)
        if i == len(self.gaps):
            return None
        gap = self.gaps[i]
        first, n = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            self.gaps.pop(i)
        return gap, first, n


def plan_packing(histogram: dict[int, int], capacities: list[int]) -> tuple[list[tuple[int, int, int, int, int, int, int]], dict[int, int]]:
    """Where the items of each size go, from the number of items of each size.

    Sizes are routed to the smallest tier that holds them. From the largest
    tier down, a tier's own sizes are packed by best fit, largest first; then
    what is free in its containers is filled by best fit with items of the
    shorter tiers, largest first; what is left of those is packed in their own
    tier. Equal containers are handled as one group, so the effort depends on
    the sizes that occur, not on the number of items.

    returns  runs (size, first rank, items, items a container, capacity, first
             container, position): the items of that size with ranks from first
             rank on go to consecutive containers, from a position in tokens;
             and the number of containers of each capacity
    """
    left = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    rank: dict[int, int] = defaultdict(int)
    runs, made = [], {}

    def assign(bins: _Bins, size: int, gap: int, first: int, n: int) -> int:
        """Put items of size into n containers with that gap; containers used."""
        each = gap // size
        full = min(n, left[size] // each)
        for containers, k in ((full, each), (1 if full < n and left[size] - full * each > 0 else 0, left[size] - full * each)):
            k = min(k, each)
            if containers and k:
                runs.append((size, rank[size], containers * k, k, bins.capacity, first, bins.capacity - gap))
                rank[size] += containers * k
                left[size] -= containers * k
                bins.put(gap - k * size, first, containers)
                first, n = first + containers, n - containers
        if n:
            bins.put(gap, first, n)
        return n

    tiers = sorted(capacities)
    for t in range(len(tiers) - 1, -1, -1):
        capacity, below = tiers[t], tiers[t - 1] if t else 0
        bins = _Bins(capacity)
        for size in sorted((s for s in left if below < s <= capacity), reverse=True):
            while left[size] and (group := bins.take(size)):
                assign(bins, size, *group)
            if left[size]:
                n = -(-left[size] // (capacity // size))
                first, bins.made = bins.made, bins.made + n
                assign(bins, size, capacity, first, n)
        for size in sorted((s for s in left if s <= below and left[s]), reverse=True):
            while left[size] and (group := bins.take(size)):
                assign(bins, size, *group)
        made[capacity] = bins.made
    return runs, made


def pack(items: DataFrame, item: str, size: str, capacities: dict[int, int], *, salts: int = SALTS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """The container of every item, with containers of several capacities.

    items       one row for each item (a repeated row counts once); size in
                tokens. Other columns are ignored
    capacities  kind of container -> capacity
    returns     item, piece, first_token, n_tokens, container_kind, container,
                position, step_group

    An item larger than the largest capacity is split into pieces of that
    capacity and a rest; no other item is split. Items without tokens (also of
    null size) take no room: their container is null. container counts from 0
    within its kind; position is where the piece begins in it. Containers of a
    kind form step groups of step_tokens capacity; equally filled containers
    are dealt out to the groups in turn, so the groups hold nearly the same.

    Only the histogram of sizes, at most as many rows as the largest capacity
    has tokens, goes to the driver. Items of one size may be any share of all:
    they are numbered in salted parts, with the parts' counts added.
    """
    largest = max(capacities.values())
    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n")).dropDuplicates(["item"])
    last = F.when(F.col("n") > 0, F.floor((F.col("n") - 1) / largest)).otherwise(0)
    pieces = rows.select("item", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece"))
    pieces = pieces.select("item", F.col("piece").cast("int").alias("piece"), (F.col("piece") * largest).alias("first_token"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("n_tokens"))
    pieces = materialize(pieces.withColumn("salt", salt("item", salts)))
    parts = pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("m"))
    histogram = {r["n_tokens"]: r["m"] for r in parts.groupBy("n_tokens").agg(F.sum("m").alias("m")).collect()}
    runs, made = plan_packing(histogram, list(capacities.values()))
    kinds = {c: k for k, c in capacities.items()}
    spark = items.sparkSession
    table = spark.createDataFrame(
        [(s, r, r + n, k, kinds[c], b, p, max(1, -(-made[c] * c // step_tokens))) for s, r, n, k, c, b, p in runs],
        "n_tokens bigint, from_rank bigint, to_rank bigint, each bigint, container_kind int, base bigint, at bigint, steps bigint",
    )
    before = F.coalesce(F.sum("m").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("n_tokens", "salt", before.alias("before"))
    numbered = pieces.withColumn("r", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("item", "piece")) - 1)
    ranked = numbered.join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    inside = (ranked["n_tokens"] == table["n_tokens"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    place = F.col("rank") - F.col("from_rank")
    container = F.col("base") + F.floor(place / F.col("each"))
    return ranked.join(table, inside, "left").select(
        F.col("item").alias(item), "piece", "first_token", ranked["n_tokens"], "container_kind", container.alias("container"),
        (F.col("at") + place % F.col("each") * table["n_tokens"]).alias("position"), (container % F.col("steps")).alias("step_group"),
    )


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """For each kind: containers, tokens in them, the share of the room that is
    used, step groups, and the fullest and emptiest step group in tokens."""
    capacity = F.create_map(*(F.lit(x) for pair in capacities.items() for x in pair))[F.col("container_kind")]
    steps = packed.where("container is not null").groupBy("container_kind", "step_group").agg(F.sum("n_tokens").alias("t"), F.max("container").alias("c"))
    per_kind = steps.groupBy("container_kind").agg((F.max("c") + 1).alias("containers"), F.sum("t").alias("tokens"), F.count("*").alias("step_groups"), F.min("t").alias("least_in_step"), F.max("t").alias("most_in_step"))
    return per_kind.withColumn("used", F.col("tokens") / (F.col("containers") * capacity))
