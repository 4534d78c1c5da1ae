"""One surviving record for each group of duplicates, chosen field by field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..session import materialize

# Entries that only say that nothing is known, in lower case.
NOTHING = [
    "n/a", "na", "n.a.", "n. a.", "none", "null", "nil", "nan", "unknown", "unbekannt", "not given", "not known", "not available", "not specified",
    "not stated", "unspecified", "undefined", "nicht bekannt", "nicht angegeben", "keine angabe", "keine angaben", "ohne angabe", "k. a.", "k.a.", "k.a",
    "k. a", "o. a.", "o.a.", "tbd", "t.b.d.", "tba", "to be determined", "missing", "leer", "empty",
]
MONTH_S = 30 * 86_400
_LAST_RANK = 1 << 30


def known(value: Column) -> Column:
    """value without outer blanks; null if it is empty, only punctuation, or
    says that nothing is known."""
    v = stripped(value)
    return F.when(v.rlike(r"[\p{L}\p{N}]") & ~F.lower(v).isin(NOTHING), v)


def value_precedence(entries: DataFrame, group: list[str], field: str, value: str, at: str, *, beyond: float = 0.0, slice_seconds: int = MONTH_S) -> DataFrame:
    """(field, earlier, later): pairs of values of a field of which, within
    groups, the one was followed by the other more often than the reverse, by
    more than beyond standard deviations of a fair coin.

    Learned from all entries with a time; equal times say nothing. A group may
    hold any share of them: its entries are put in order within slices of time,
    and only the last value of a slice crosses to the next.
    """
    keys = [*group, field]
    rows = entries.where(F.col(at).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(at).alias("_t"))
    rows = rows.withColumn("_b", F.floor(F.unix_timestamp(F.col("_t").cast("timestamp")) / F.lit(slice_seconds)))
    before = F.lag(F.struct("_t", "_v")).over(Window.partitionBy(*keys, "_b").orderBy("_t", "_v"))
    last = rows.groupBy(*keys, "_b").agg(F.max(F.struct("_t", "_v")).alias("_l"))
    last = last.withColumn("_l", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")))
    moves = rows.withColumn("_q", before).join(last, [*keys, "_b"], "left").withColumn("_q", F.coalesce("_q", "_l")).where("_q._t < _t").withColumn("_p", F.col("_q._v")).where("_p <> _v")
    low, high = F.least("_p", "_v"), F.greatest("_p", "_v")
    net = moves.groupBy(field, low.alias("_a"), high.alias("_z")).agg(F.sum(F.when(F.col("_p") == low, 1).otherwise(-1)).alias("_n"), F.count("*").alias("_m"))
    net = net.where((F.col("_n") != 0) & (F.abs("_n") > beyond * F.sqrt("_m")))
    forward = F.col("_n") > 0
    return net.select(field, F.when(forward, F.col("_a")).otherwise(F.col("_z")).alias("earlier"), F.when(forward, F.col("_z")).otherwise(F.col("_a")).alias("later"))


def closed_precedence(learned: DataFrame, among: DataFrame, field: str) -> DataFrame:
    """(field, earlier, later): how learned precedences order the values in
    among (field, value), directly or over any others between. Values that lead
    to each other both ways (a cycle) count as one: nothing orders them."""
    keys = [field, "earlier", "later"]
    among = materialize(among.select(field, "value").distinct())
    if among.isEmpty():
        return learned.select(*keys)
    learned = materialize(learned.select(*keys))
    reached = frontier = materialize(learned.join(among.withColumnRenamed("value", "earlier"), [field, "earlier"], "left_semi"))
    step = learned.select(field, F.col("earlier").alias("later"), F.col("later").alias("_next"))
    while not frontier.isEmpty():  # each round one precedence further, until nothing new is reached
        onward = frontier.join(step, [field, "later"]).where("earlier <> _next").select(field, "earlier", F.col("_next").alias("later")).distinct()
        frontier = materialize(onward.join(reached, keys, "left_anti"))
        reached = reached.unionByName(frontier)
    reached = materialize(reached.join(among.withColumnRenamed("value", "later"), [field, "later"], "left_semi").select(*keys).distinct())
    back = reached.select(field, F.col("later").alias("earlier"), F.col("earlier").alias("later"))
    return reached.join(back, keys, "left_anti")


def latest_by_currency(candidates: DataFrame, learned: DataFrame, on: list[str], field: str) -> DataFrame:
    """candidates (on, value, seen) with n_later: how many of the other
    candidates of the same group and field come after each.

    The partial order of a group: of two values that the group dates, the one
    seen last is later; where one has no time or the times are equal, learned
    precedence decides, if it says anything. The topologically latest values
    have n_later 0.
    """
    dated = F.rank().over(Window.partitionBy(*on).orderBy(F.desc_nulls_last("seen"))) - 1
    ordered = candidates.withColumn("_by_time", F.when(F.col("seen").isNotNull(), dated).otherwise(0))
    rest = [c for c in on if c != field]
    succeeded = (
        candidates.select(*on, F.col("value").alias("earlier"), F.col("seen").alias("_s1")).join(learned, [field, "earlier"])
        .join(candidates.select(*on, F.col("value").alias("later"), F.col("seen").alias("_s2")), [*rest, field, "later"])
        .where("_s1 is null or _s2 is null or _s1 = _s2").groupBy(*on, F.col("earlier").alias("value")).agg(F.count("*").alias("_by_order"))
    )
    joined = ordered.join(succeeded, [*on, "value"], "left")
    return joined.withColumn("n_later", F.col("_by_time") + F.coalesce("_by_order", F.lit(0))).drop("_by_time", "_by_order")


def _entries(df: DataFrame, group: list[str], record_id: str, fields: str | Column, at: str, *others: Column) -> tuple[DataFrame, DataFrame]:
    """The known values of all fields as rows, and the groups of two records or
    more."""
    rows = df.select(*group, F.col(record_id).alias("_id"), (fields if isinstance(fields, Column) else F.col(fields)).alias("_f"), F.col(at).alias("_t"), *others)
    for c in [*group, "_id"]:
        rows = rows.where(F.col(c).isNotNull())
    repeated = rows.groupBy(*group).agg(F.min("_id").alias("_a"), F.max("_id").alias("_z")).where("_a < _z").select(*group)
    kept = [c for c in rows.columns if c != "_f"]
    return rows.select(*kept, F.explode("_f").alias("field", "value")).withColumn("value", known(F.col("value"))).where("value is not null"), repeated


def surviving_fields(df: DataFrame, group: list[str], record_id: str, fields: str | Column, trust: str, at: str, *, beyond: float = 0.0) -> DataFrame:
    """The value that survives in each field of each group.

    It is from the records with the best (smallest) trust rank among those where
    the field has a value: from the latest of them, or one that has no time.
    Where these have several values, because times are missing or equal,
    currency decides (see latest_by_currency): the topologically latest value of
    the group's partial order survives; of several the one with a time, then the
    most frequent, then the greatest in order of text. Where learned precedence
    and times contradict each other, so that each has a later one, it is the one
    with the fewest later ones.

    df        fields is a map of field to value (text)
    beyond    how much clearer than a fair coin a learned precedence must be, in
              standard deviations
    returns   group columns, field, value

    Only groups of at least two different record ids give rows, and fields
    only where a record has a value (see known()). A missing rank comes last.
    Repeated rows count once. Rows with a null group column or record id are in
    no group. A group may hold any share of the rows: values are aggregated
    before they are shuffled.
    """
    entries, repeated = _entries(df, group, record_id, fields, at, F.coalesce(-F.col(trust), F.lit(-_LAST_RANK)).cast("int").alias("_r"))
    h = F.xxhash64("value")
    top, undated = F.struct("_r", "_t"), F.col("_t").isNull()
    least = lambda rank: F.max(F.struct(rank.alias("r"), F.bitwise_not(h).alias("h")))  # noqa: E731 - the greatest complement is the least hash
    best = entries.groupBy(*group, "field").agg(
        F.max(F.struct("_r", "_t", h.alias("h"), "value")).alias("_a"), least(top).alias("_z"), F.max(F.when(undated, F.struct("_r", h.alias("h")))).alias("_ua"), F.max(F.when(undated, F.struct("_r", F.bitwise_not(h).alias("h")))).alias("_uz"),
    )
    others = (F.col("_ua._r") == F.col("_a._r")) & ((F.col("_ua.h") != F.col("_a.h")) | (F.col("_a.h") != F.bitwise_not("_uz.h")))
    several = (F.col("_a.h") != F.bitwise_not("_z.h")) | F.coalesce(others, F.lit(False))
    best = materialize(best.join(repeated, group).select(*group, "field", F.col("_a._r").alias("_br"), F.col("_a._t").alias("_bt"), "_a.value", several.alias("open")))
    decided = best.where("not open").select(*group, "field", "value")
    on = [*group, "field"]
    seen = entries.join(best.where("open").select(*on, "_br", "_bt"), on)
    leads = (F.col("_r") == F.col("_br")) & (F.col("_t").eqNullSafe(F.col("_bt")) | undated)
    candidates = seen.groupBy(*on, "value").agg(F.max(leads).alias("_top"), F.max("_t").alias("seen"), F.count_if(leads).alias("_n"), F.max(leads & ~undated).alias("_dated")).where("_top").drop("_top")
    learned = closed_precedence(value_precedence(entries, group, "field", "value", "_t", beyond=beyond), candidates, "field")
    order = F.struct((-F.col("n_later")).alias("o"), "_dated", "_n", "value")
    chosen = latest_by_currency(candidates, learned, on, "field").groupBy(*on).agg(F.max(order).getField("value").alias("value"))
    return decided.unionByName(chosen)


def current_fields(df: DataFrame, group: list[str], record_id: str, fields: str | Column, at: str, *, beyond: float = 2.0, folds: int = 2) -> DataFrame:
    """The value of each field that currency reasoning alone takes for the
    latest, with a group's own times hidden: how far it can be relied on where
    times are missing.

    Groups are dealt into folds by a hash; the precedence that orders the values
    of a fold is learned from the times of the other folds.

    returns   group columns, field, value, n_later (how many of the group's other
              values come after it), n_values, latest (the value with the latest
              time, the greatest in order of text if there are several)

    Rows as in surviving_fields. Fields of which a group has but one value have
    that one. Values without any time are candidates too; latest is null where
    no value has a time.
    """
    entries, repeated = _entries(df, group, record_id, fields, at)
    entries = materialize(entries.join(repeated, group, "left_semi").withColumn("_fold", F.pmod(F.xxhash64(*group), F.lit(folds)).cast("int")))
    on = [*group, "field"]
    values = entries.groupBy(*on, "_fold", "value").agg(F.count("*").alias("_n"), F.max("_t").alias("_last"))
    several = values.groupBy(*on).agg(F.count("*").alias("n_values"), F.max(F.when(F.col("_last").isNotNull(), F.struct("_last", "value"))).getField("value").alias("latest"))
    chosen = []
    for fold in range(folds):
        own = values.where(F.col("_fold") == fold).withColumn("seen", F.lit(None).cast("timestamp"))
        learned = closed_precedence(value_precedence(entries.where(F.col("_fold") != fold), group, "field", "value", "_t", beyond=beyond), own, "field")
        best = F.max(F.struct((-F.col("n_later")).alias("o"), "_n", "value")).alias("_b")
        chosen.append(latest_by_currency(own, learned, on, "field").groupBy(*on).agg(best).select(*on, "_b.value", (-F.col("_b.o")).alias("n_later")))
    return reduce(DataFrame.unionByName, chosen).join(several, on)
