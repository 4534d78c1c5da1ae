"""Comparison of expected and extracted values as column expressions.

All scores lie in [0, 1] and are asymmetric where the first argument is the
expected value.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normal, tokens


class MatchStrategy(str, Enum):
    EXACT = "exact"
    NORMALIZED = "normalized"
    TOKEN_OVERLAP = "token_overlap"
    EMBEDDING = "embedding"


def match_exact(expected: Column, extracted: Column) -> Column:
    return F.when(expected == extracted, 1.0).otherwise(0.0)


def match_normalized(expected: Column, extracted: Column) -> Column:
    return F.when(normal(expected) == normal(extracted), 1.0).otherwise(0.0)


def overlap(expected: Column, extracted: Column) -> Column:
    """Share of the expected tokens that were extracted, of two arrays of
    distinct tokens; without expected tokens 1 if there are no others either."""
    n = F.size(expected)
    return F.when(n == 0, F.when(F.size(extracted) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(expected, extracted)) / n)


def match_token_overlap(expected: Column, extracted: Column) -> Column:
    return overlap(tokens(expected), tokens(extracted))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, not below 0; 0 if one of them has no length."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.greatest(F.lit(0.0), F.nanvl(dot(a, b) / norms, F.lit(0.0)))).otherwise(0.0)


def match_numeric(expected: Column, extracted: Column) -> Column:
    """1 - relative error, at least 0; an expected 0 is met by 0 alone; not a
    number meets nothing."""
    e, x = expected.cast("double"), extracted.cast("double")
    bad = F.isnan(e) | F.isnan(x)
    return F.when(bad, 0.0).when(e == 0, F.when(x == 0, 1.0).otherwise(0.0)).otherwise(F.nanvl(F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(e - x) / F.when(e != 0, F.abs(e))), F.lit(0.0)))


def match(strategy: MatchStrategy | str, expected: Column, extracted: Column) -> Column:
    """Score by strategy; an unknown strategy is exact."""
    scorers = {MatchStrategy.NORMALIZED: match_normalized, MatchStrategy.TOKEN_OVERLAP: match_token_overlap, MatchStrategy.EMBEDDING: cosine}
    return scorers.get(strategy, match_exact)(expected, extracted)


def as_text(value: Column, kind: T.DataType, top: bool = True) -> Column:
    """A value as the text that Python prints for it: what nested and listed
    values are compared by. Numbers in exponent form differ."""
    none = F.lit("None")
    if isinstance(kind, T.BooleanType):
        return F.when(value.isNull(), none).when(value, "True").otherwise("False")
    if isinstance(kind, T.StringType):
        return value if top else F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), none)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: as_text(x, kind.elementType, False)), ", "), F.lit("]")), none)
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(f"{f.name}="), as_text(value[f.name], f.dataType, False)) for f in kind.fields]
        joined = F.concat_ws(" " if top else ", ", *fields)
        return F.coalesce(F.when(value.isNotNull(), joined if top else F.concat(F.lit("("), joined, F.lit(")"))), none)
    return F.coalesce(value.cast("string"), none)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def compare_values(expected: Column, extracted: Column, expected_type: T.DataType, extracted_type: T.DataType, strategy: MatchStrategy | str = MatchStrategy.NORMALIZED, threshold: float = 0.8) -> Column:
    """STRUCT(match, score, strategy, expected, extracted) of two values.

    The branch follows from the types when the plan is built. Two nulls match
    with score 1 and a single null never matches, whatever the threshold.
    """
    label = strategy.value if isinstance(strategy, MatchStrategy) else str(strategy)
    shown = (expected.cast("string"), extracted.cast("string"))
    if isinstance(expected_type, T.BooleanType):
        label = "exact"
        score = F.when(expected.cast("double") == extracted.cast("double"), 1.0).otherwise(0.0) if _numeric(extracted_type) else F.lit(0.0)
        shown = (as_text(expected, expected_type), as_text(extracted, extracted_type))
    elif isinstance(expected_type, T.NumericType):
        label = "numeric"
        score = match_numeric(expected, extracted) if _numeric(extracted_type) else F.lit(0.0)
    else:
        shown = (as_text(expected, expected_type), as_text(extracted, extracted_type))
        score = match(strategy, *shown)
    both, one = expected.isNull() & extracted.isNull(), expected.isNull() | extracted.isNull()
    score = F.when(both, 1.0).when(one, 0.0).otherwise(score)
    hit = F.when(both, True).when(one, False).otherwise(score >= threshold)
    return F.struct(
        hit.alias("match"), score.alias("score"), F.when(one, F.lit(strategy.value if isinstance(strategy, MatchStrategy) else str(strategy))).otherwise(label).alias("strategy"),
        F.when(expected.isNotNull(), shown[0]).alias("expected"), F.when(extracted.isNotNull(), shown[1]).alias("extracted"),
    )
