"""One-to-one assignment of extracted to expected records, in expected order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import MatchStrategy, cosine
from ..functions.text import normal, tokens
from ..session import materialize, whole_groups

#: Groups with more candidates than this fall into components first.
FOLD_LIMIT = 20_000


def pair_by_key(expected: DataFrame, extracted: DataFrame, group: str, key: str, pos: str = "pos") -> DataFrame:
    """(group, e, x): the k-th expected and the k-th extracted record of equal
    keys. For strategies that score 0 or 1 this is what greedy assignment gives."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(group, key).orderBy(pos)
        return df.select(group, F.col(key).alias("_k"), F.col(pos).alias(name), F.row_number().over(w).alias("_n"))

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return ranked(df.withColumn(key, F.coalesce(F.concat(F.lit("v"), F.col(key)), F.lit("null"))), name)

    return numbered(expected, "e").join(numbered(extracted, "x"), [group, "_k", "_n"]).select(group, "e", "x")


def _alike(e: DataFrame, x: DataFrame, keys: list[str], all_pairs: bool) -> DataFrame:
    """Pairs of records that are the same to a strategy; unless all pairs are
    asked for, the k-th with the k-th, which is all that assignment uses."""
    if not all_pairs:
        e, x = (d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(c))) for d, c in ((e, "e"), (x, "x")))
        keys = [*keys, "_n"]
    return e.join(x, keys).select(keys[0], "e", "x", F.lit(1.0).alias("score"))


def _token_pairs(et: DataFrame, xt: DataFrame, group: str, least: float) -> DataFrame:
    """(group, e, x, score) of records that share a token, with a score of at
    least least. et and xt have (group, e or x, t), t the distinct tokens.

    Of m tokens at least ceil(least * m) must be found. So one of any m -
    ceil(least * m) + 1 of them is: only the rarest so many are looked up, and
    frequent tokens bring no candidates together. A pair met by several of them
    is kept where the first of them meets."""
    words = F.explode("t").alias("k")
    if least <= 0:
        common = et.select(group, "e", F.size("t").alias("size"), words).join(xt.select(group, "x", words), [group, "k"])
        return common.groupBy(group, "e", "x").agg((F.count("*") / F.first("size")).alias("score"))
    known = xt.select(group, words).groupBy(group, "k").agg(F.count("*").alias("df"))
    ranked = et.select(group, "e", words).join(known, [group, "k"], "left").select(group, "e", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "k").alias("w"))
    ordered = ranked.groupBy(group, "e").agg(F.array_sort(F.collect_list("w")).alias("w")).select(group, "e", F.transform("w", lambda w: w["k"]).alias("t"))
    need = F.ceil(F.size("t") * F.lit(float(least)) - 1e-9)
    prefix = F.slice("t", F.lit(1), F.greatest(F.size("t") - need + 1, F.lit(0)).cast("int"))
    asked = ordered.select(group, "e", "t", prefix.alias("p")).select(group, "e", "t", "p", F.explode("p").alias("k"))
    met = asked.join(xt.select(group, "x", F.col("t").alias("xt"), words), [group, "k"])
    first = F.get(F.filter("p", lambda w: F.array_contains("xt", w)), F.lit(0))
    score = F.size(F.array_intersect("t", "xt")) / F.size("t")
    return met.where(first == F.col("k")).select(group, "e", "x", score.alias("score")).where(F.col("score") >= least)


def candidates(expected: DataFrame, extracted: DataFrame, group: str, name: str, pos: str = "pos", strategy: MatchStrategy | str = MatchStrategy.TOKEN_OVERLAP, all_pairs: bool = True, least: float = 0.0) -> DataFrame:
    """(group, e, x, score) of the pairs of a group with a positive score of at
    least least.

    Token overlap joins on tokens (with least, on the rarest ones), exact and
    normalized on the key; only embeddings are compared pair by pair, within
    their group. Two nulls score 1, and so do two names without tokens. Without
    all_pairs, records that are the same (two nulls, equal keys) are paired in
    order: greedy assignment takes no other pairs of them.
    """
    e, x = expected.select(group, F.col(pos).alias("e"), F.col(name).alias("n")), extracted.select(group, F.col(pos).alias("x"), F.col(name).alias("n"))
    nulls = _alike(e.where("n is null").drop("n"), x.where("n is null").drop("n"), [group], all_pairs)
    if strategy == MatchStrategy.EMBEDDING:
        found = e.withColumnRenamed("n", "a").join(x.withColumnRenamed("n", "b"), group).select(group, "e", "x", cosine(F.col("a"), F.col("b")).alias("score"))
    elif strategy == MatchStrategy.TOKEN_OVERLAP:
        et = e.where("n is not null").select(group, "e", tokens(F.col("n")).alias("t"))
        xt = x.where("n is not null").select(group, "x", tokens(F.col("n")).alias("t"))
        found = _token_pairs(et, xt, group, least)
        found = found.unionByName(_alike(et.where(F.size("t") == 0).select(group, "e"), xt.where(F.size("t") == 0).select(group, "x"), [group], all_pairs))
    else:
        key = (lambda c: normal(c)) if strategy == MatchStrategy.NORMALIZED else (lambda c: c)
        keyed = [d.where("n is not null").withColumn("n", key(F.col("n"))) for d in (e, x)]
        found = _alike(*keyed, [group, "n"], all_pairs)
    return found.where((F.col("score") > 0) & (F.col("score") >= least)).unionByName(nulls)


def components(pairs: DataFrame, group: str) -> DataFrame:
    """(group, e, comp): expected records that are linked through extracted ones
    they both may take have the same comp, the least e among them. Each round
    passes the least label on over one extracted record, and jumps to the label
    of the label, so that long chains take few rounds."""
    links = materialize(pairs.select(group, "e", "x"))
    labels = materialize(links.select(group, "e").distinct().withColumn("comp", F.col("e")))
    while True:
        by_x = links.join(labels, [group, "e"]).groupBy(group, "x").agg(F.min("comp").alias("comp"))
        heard = links.join(by_x, [group, "x"]).groupBy(group, "e").agg(F.min("comp").alias("heard"))
        near = materialize(labels.join(heard, [group, "e"]).select(group, "e", "comp", F.least("comp", "heard").alias("near")))
        up = near.select(group, F.col("e").alias("near"), F.col("near").alias("far"))
        after = materialize(near.join(up, [group, "near"]).select(group, "e", F.least("near", "far").alias("next"), "comp"))
        if after.where("next < comp").isEmpty():
            return labels
        labels = after.select(group, "e", F.col("next").alias("comp"))


def greedy(pairs: DataFrame, group: str, threshold: float, *, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(group, e, x, score): for each expected record, in order of e, the best
    extracted record that no earlier one has taken (ties: the smallest x) if
    its score is at least threshold; else x is null, and score is that of the
    best one left, or 0.

    Expected records without any candidate are not in the result. Groups of
    ordinary size are folded inside the JVM. Groups with more candidates than
    fold_limit fall into connected components first, which do not depend on each
    other, so that a group may hold any share of the rows; a component that is
    still larger passes sorted through one Python worker, which holds only the
    taken positions. The result is the same either way.
    """
    pairs = materialize(pairs)
    sizes = materialize(pairs.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > fold_limit))
    if sizes.isEmpty():
        return _fold(pairs, group, [group], threshold)
    large = pairs.join(sizes.select(group), group, "left_semi")
    large = materialize(large.join(components(large, group), [group, "e"]))
    counted = large.join(large.groupBy(group, "comp").agg(F.count("*").alias("_n")), [group, "comp"])
    return (
        _fold(pairs.join(sizes, group, "left_anti"), group, [group], threshold)
        .unionByName(_fold(counted.where(F.col("_n") <= fold_limit), group, [group, "comp"], threshold))
        .unionByName(_stream(counted.where(F.col("_n") > fold_limit), group, ["comp"], threshold))
    )


def _fold(pairs: DataFrame, group: str, keys: list[str], threshold: float) -> DataFrame:
    """Greedy assignment of whole lists, inside the JVM."""
    own = pairs.groupBy(*keys, "e").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("ns"), "x"))).alias("c"))
    lists = own.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("e", "c"))).alias("es"))
    kind = dict(pairs.dtypes)["x"]
    start = F.struct(F.array().cast(f"array<{kind}>").alias("used"), F.array().cast(f"array<struct<e:{dict(pairs.dtypes)['e']},x:{kind},score:double>>").alias("log"))

    def step(acc, row):
        best = F.get(F.filter(row["c"], lambda c: ~F.array_contains(acc["used"], c["x"])), F.lit(0))
        hit = -best["ns"] >= threshold
        return F.struct(
            F.when(hit, F.concat(acc["used"], F.array(best["x"]))).otherwise(acc["used"]).alias("used"),
            F.concat(acc["log"], F.array(F.struct(row["e"].alias("e"), F.when(hit, best["x"]).alias("x"), F.coalesce(-best["ns"], F.lit(0.0)).alias("score")))).alias("log"),
        )

    return lists.select(group, F.explode(F.aggregate("es", start, step, lambda acc: acc["log"])).alias("l")).select(group, "l.e", "l.x", "l.score")


def _stream(pairs: DataFrame, group: str, within: list[str], threshold: float) -> DataFrame:
    """Greedy assignment in one pass over sorted pairs."""
    large = pairs.select(group, *within, "e", "x", "score")
    streamed = whole_groups(large, [group, *within], group, *within, "e", F.desc("score"), "x")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used, owner, best, taken, seen = None, set(), None, 0.0, None, False
        for pdf in batches:
            out = []
            for g, *part, e, x, score in pdf.itertuples(index=False):
                g = (g, *part)
                if (g, e) != (current, owner):
                    if owner is not None:
                        out.append((current[0], owner, taken, best))
                    if g != current:
                        used = set()
                    current, owner, best, taken, seen = g, e, 0.0, None, False
                if not seen and x not in used:
                    seen, best = True, score
                    if score >= threshold:
                        taken = x
                        used.add(x)
            yield pd.DataFrame(out, columns=[group, "e", "x", "score"]).astype({"x": "Int64"})
        if owner is not None:
            yield pd.DataFrame([(current[0], owner, taken, best)], columns=[group, "e", "x", "score"]).astype({"x": "Int64"})

    types = dict(pairs.dtypes)
    return streamed.mapInPandas(stream, f"`{group}` {types[group]}, e {types['e']}, x {types['x']}, score double")
