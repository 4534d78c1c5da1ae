"""Expected against extracted records: entities, attributes, relations, levels.

Records are rows with a group (the list they belong to) and a position in it;
each function works on all groups at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.matching import MatchStrategy, as_text, compare_values, match
from ..functions.metrics import prf1
from ..functions.text import normal, tokens
from ..schema import fields
from ..session import materialize
from .assign import candidates, greedy, pair_by_key

_SHORTCUT = (MatchStrategy.EXACT, MatchStrategy.NORMALIZED)


def _log(expected: DataFrame, extracted: DataFrame, assigned: DataFrame, group: str, shown: list[str], pos: str) -> DataFrame:
    """TP, FN and FP rows from the assignment; shown columns of either side."""
    e = expected.select(group, F.col(pos).alias("e"), *(F.col(c).alias(f"expected_{c}") for c in shown))
    x = extracted.select(group, F.col(pos).alias("x"), *(F.col(c).alias(f"extracted_{c}") for c in shown))
    left = e.join(assigned, [group, "e"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    both = left.join(x, [group, "x"], "left").withColumn("status", F.when(F.col("x").isNotNull(), "TP").otherwise("FN"))
    extra = x.join(assigned.where("x is not null").select(group, "x"), [group, "x"], "left_anti").withColumns({"status": F.lit("FP"), "score": F.lit(0.0)})
    return both.unionByName(extra, allowMissingColumns=True).withColumn("score", F.round("score", 3))


def entity_detection(expected: DataFrame, extracted: DataFrame, group: str, name: str = "name", strategy: MatchStrategy | str = MatchStrategy.TOKEN_OVERLAP, threshold: float = 0.6, pos: str = "pos", miss_scores: bool = True) -> DataFrame:
    """The match log: (group, e, x, expected_name, extracted_name, status, score).

    Expected records are taken in order of position, each with the best
    extracted one not yet taken (ties: the first) whose score is positive and
    at least threshold. FN rows show the best score that was left, or without
    miss_scores 0, which spares all pairs below the threshold. Types are not
    looked at. Empty groups on either side give FN or FP rows alone;
    positions must be unique within a group.
    """
    if strategy in _SHORTCUT and 0 < threshold <= 1:
        key = (lambda c: normal(F.col(c))) if strategy == MatchStrategy.NORMALIZED else F.col
        sides = [d.select(group, pos, key(name).alias("_key")) for d in (expected, extracted)]
        assigned = pair_by_key(*sides, group, "_key", pos).withColumn("score", F.lit(1.0))
    else:
        assigned = greedy(candidates(expected, extracted, group, name, pos, strategy, all_pairs=False, least=0.0 if miss_scores else threshold), group, threshold)
    return _log(expected, extracted, assigned, group, [name], pos)


def attributes(pairs: DataFrame, fields: list[str], strategy: MatchStrategy | str = MatchStrategy.TOKEN_OVERLAP, threshold: float = 0.6, explicit: bool = False) -> DataFrame:
    """One row for each compared field of each pair (columns expected_f and
    extracted_f for f in fields): field, status, score and both values.

    Without explicit fields, only those whose expected value is not null are
    compared. A differing value is WRONG (a false negative, never a false
    positive); with explicit fields an extracted value without an expected one
    is FP, and a field null on both sides is skipped.
    """
    types = {f.name: f.dataType for f in pairs.schema.fields}
    rows = []
    for f in fields:
        e, x = F.col(f"expected_{f}"), F.col(f"extracted_{f}")
        c = compare_values(e, x, types[f"expected_{f}"], types[f"extracted_{f}"], strategy, threshold)
        status = F.when(e.isNull() & x.isNull(), None).when(e.isNull(), "FP" if explicit else None).when(x.isNull(), "FN").when(c["match"], "TP").otherwise("WRONG")
        rows.append(F.struct(F.lit(f).alias("field"), status.alias("status"), c["score"].alias("score"), c["expected"].alias("expected"), c["extracted"].alias("extracted")))
    kept = [c for c in pairs.columns if not c.startswith(("expected_", "extracted_"))]
    return pairs.select(*kept, F.explode(F.filter(F.array(*rows), lambda r: r["status"].isNotNull())).alias("_r")).select(*kept, "_r.*")


def players(df: DataFrame, roles: list[str]) -> tuple[dict[str, Column], dict[str, Column]]:
    """What the role players of relations are compared by, and what a log shows
    of them. A column with names stands for itself, a record for its name; a
    list or a record that has no name is compared as text and shown as null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    compared, shown = {}, {}
    for r in roles:
        named = isinstance(kinds[r], T.StructType) and "name" in kinds[r].fieldNames()
        plain = not isinstance(kinds[r], (T.StructType, T.ArrayType))
        compared[r] = F.col(f"{r}.name") if named else F.col(r) if plain else F.when(F.col(r).isNotNull(), as_text(F.col(r), kinds[r]))
        shown[r] = compared[r] if named or plain else F.lit(None).cast("string")
    return compared, shown


def _role_pairs(expected: DataFrame, extracted: DataFrame, group: str, roles: list[str], strategy: MatchStrategy | str) -> DataFrame:
    """(group, e, x, score) of relations with a positive mean of role scores.
    All roles are met in one join on (role, token); a missing player counts as a
    token that only missing players have, and so does a name without tokens."""
    def met(df: DataFrame, p: str) -> DataFrame:
        def words(r: str) -> Column:
            own = tokens(F.col(r)) if strategy == MatchStrategy.TOKEN_OVERLAP else F.array(F.concat(F.lit("v"), normal(F.col(r)) if strategy == MatchStrategy.NORMALIZED else F.col(r)))
            return F.when(F.col(r).isNull(), F.array(F.lit("\0null"))).when(F.size(own) == 0, F.array(F.lit("\0empty"))).otherwise(own)

        each = F.array(*(F.struct(F.lit(i).alias("role"), words(r).alias("t")) for i, r in enumerate(roles)))
        return df.select(group, p, F.explode(each).alias("r")).select(group, p, "r.role", F.size("r.t").alias(f"{p}_size"), F.explode("r.t").alias("k"))

    hits = met(expected, "e").join(met(extracted, "x").drop("x_size"), [group, "role", "k"])
    mean = reduce(lambda p, q: p + q, (F.count_if(F.col("role") == i) / F.coalesce(F.max(F.when(F.col("role") == i, F.col("e_size"))), F.lit(1)) for i in range(len(roles)))) / len(roles)
    return hits.groupBy(group, "e", "x").agg(mean.alias("score"))


def relation_detection(expected: DataFrame, extracted: DataFrame, group: str, roles: list[str], strategy: MatchStrategy | str = MatchStrategy.TOKEN_OVERLAP, threshold: float = 0.6, pos: str = "pos") -> DataFrame:
    """The match log of relations by the mean of their role scores.

    roles are columns with the name of each player, or with the player itself
    (see players). A pair is a candidate if one role has a positive score; two
    missing players score 1. Without roles nothing matches. Groups without
    expected or without extracted relations give FN or FP rows alone.
    """
    sides, logs = [], []
    for df, p in ((expected, "e"), (extracted, "x")):
        compared, shown = players(df, roles)
        sides.append(df.select(group, F.col(pos).alias(p), *(compared[r].alias(r) for r in roles)))
        logs.append(df.select(group, F.col(pos).alias(pos), *(shown[r].alias(r) for r in roles)))
    e, x = sides
    if not roles:
        pairs = e.join(x, group).select(group, "e", "x", F.lit(0.0).alias("score")).where("score > 0")
    elif strategy == MatchStrategy.EMBEDDING:
        a, b = (d.select(group, p, *(F.col(r).alias(f"{p}_{r}") for r in roles)) for d, p in ((e, "e"), (x, "x")))

        def score(r: str) -> Column:
            u, v = F.col(f"e_{r}"), F.col(f"x_{r}")
            return F.when(u.isNull() & v.isNull(), 1.0).when(u.isNull() | v.isNull(), 0.0).otherwise(match(strategy, u, v))

        pairs = a.join(b, group).select(group, "e", "x", (reduce(lambda p, q: p + q, map(score, roles)) / len(roles)).alias("score")).where("score > 0")
    else:
        pairs = _role_pairs(e, x, group, roles, strategy)
    return _log(*logs, greedy(pairs, group, threshold), group, roles, pos)


def level_pairs(log: DataFrame, expected: DataFrame, extracted: DataFrame, group: str, fields: list[str], name: str = "name", pos: str = "pos") -> DataFrame:
    """The true positives of an entity log with the fields of both records,
    looked up by name, where the first record of a name counts."""
    def firsts(df: DataFrame, side: str) -> DataFrame:
        row = F.min_by(F.struct(*fields), pos)
        return df.groupBy(group, F.col(name).alias(f"{side}_{name}")).agg(row.alias("_r")).select(group, f"{side}_{name}", *(F.col(f"_r.{f}").alias(f"{side}_{f}") for f in fields if f != name))

    hits = log.where("status = 'TP'").select(group, "e", f"expected_{name}", f"extracted_{name}")
    return hits.join(firsts(expected, "expected"), [group, f"expected_{name}"]).join(firsts(extracted, "extracted"), [group, f"extracted_{name}"])


def default_fields(record: str) -> list[str]:
    """The fields of a record type that are compared unless others are given:
    all in their order but source_text and description."""
    return [f.name for f in fields(record) if f.name not in ("source_text", "description")]


def evaluate_level(expected: DataFrame, extracted: DataFrame, group: str, compared: list[str] | str, expected_relations: DataFrame | None = None, extracted_relations: DataFrame | None = None, roles: list[str] | None = None, *, name: str = "name", strategy: MatchStrategy | str = MatchStrategy.TOKEN_OVERLAP, threshold: float = 0.6, relation_type: str = "Unknown") -> dict[str, DataFrame]:
    """Logs and metrics of a level, for each group.

    compared  the fields whose values are compared, or a record type, for its
              default ones (of those that both sides have)
    returns   entity_log, entity_metrics (category: the type of the first
              expected record, if there is a column type, else 'Unknown'),
              attribute_log and attribute_metrics of each pair found (e, category
              'attrs:<name>'), and, where relations of both sides and roles are
              given, relation_log and relation_metrics (category: the type of the
              first expected relation, if there is a column type, else
              relation_type); these leave out groups that lack relations on
              either side.
    """
    if isinstance(compared, str):
        compared = [f for f in default_fields(compared) if f in expected.columns and f in extracted.columns]

    def kinds(df: DataFrame, otherwise: str) -> DataFrame:
        return df.groupBy(group).agg(F.coalesce(F.min_by("type", "pos") if "type" in df.columns else F.lit(None), F.lit(otherwise)).alias("category"))

    log = materialize(entity_detection(expected, extracted, group, name, strategy, threshold))
    with_kind = log.join(kinds(expected, "Unknown"), group, "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))
    pairs = level_pairs(log, expected, extracted, group, compared, name).withColumn("category", F.concat(F.lit("attrs:"), F.coalesce(f"expected_{name}", F.lit("None"))))
    attribute_log = attributes(pairs, compared, strategy, threshold)
    out = {
        "entity_log": log, "entity_metrics": prf1(with_kind, group, "category"), "attribute_log": attribute_log, "attribute_metrics": prf1(attribute_log, group, "e", "category"),
    }
    if expected_relations is not None and extracted_relations is not None and roles:
        relations = relation_detection(expected_relations, extracted_relations, group, roles, strategy, threshold)
        for side in (expected_relations, extracted_relations):
            relations = relations.join(side.select(group).distinct(), group, "left_semi")
        relations = materialize(relations.join(kinds(expected_relations, relation_type), group))
        out |= {"relation_log": relations.drop("category"), "relation_metrics": prf1(relations, group, "category")}
    return out
