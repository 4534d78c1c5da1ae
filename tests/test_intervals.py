import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grafloom.operators.intervals import periods_and_gaps, whole_ms


def by_hand(rows):
    out, groups = [], {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            groups.setdefault(k, []).append((s, e))
    for k, own in groups.items():
        periods = []
        for s, e in sorted(own):
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
            else:
                periods.append([s, e])
        out += [(k, "period", s, e) for s, e in periods]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=str)


def got(spark, rows, width):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    return sorted((tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", slice_width=width).collect()), key=str)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_random_intervals(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), s := rng.randint(-60, 60), s + rng.choice([-1, 0, 1, 2, 5, 30])) for _ in range(300)]
    rows += [("c", i * 10, i * 10 + rng.choice([3, 10, 12])) for i in range(40)]
    assert got(spark, rows + rows[:20], width) == by_hand(rows)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-20, 20), st.integers(-20, 25)), max_size=12))
def test_any_intervals(spark, rows):
    assert got(spark, rows, 5) == by_hand(rows)


def test_edges(spark):
    assert got(spark, [], 10) == []
    assert got(spark, [("a", None, 5), ("a", 5, None), ("a", 3, 3), ("a", 4, 1)], 10) == []
    assert got(spark, [("a", 0, 10**15), ("a", 5, 6), ("a", 10**15, 10**15 + 1)], 3_600_000) == [("a", "period", 0, 10**15 + 1)]


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 3, 0, "x", 9)], "k string, s bigint, e bigint, d int, kind string, t int")
    assert [tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e").collect()] == [("a", "period", 1, 3)]


def test_whole_ms(spark):
    values = [1.0005, None, float("nan"), float("inf"), 1e20, -0.0004, 12.345]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(whole_ms(F.col("x"))).collect()] == [1001, None, None, None, None, 0, 12345]
