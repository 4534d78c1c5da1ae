import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from grafloom.llm.survivor import current_fields, known, surviving_fields, value_precedence

SCHEMA = "grp string, rec bigint, fields map<string,string>, trust int, at timestamp, field string, value string"
DAY = datetime(2025, 1, 1)


def at(days):
    return None if days is None else DAY + timedelta(days=days)


def survive(spark, rows):
    df = spark.createDataFrame([(g, r, f, t, at(d), "clash", "clash") for g, r, f, t, d in rows], SCHEMA)
    return {(r["grp"], r["field"]): r["value"] for r in surviving_fields(df, ["grp"], "rec", "fields", "trust", "at").collect()}


@pytest.mark.parametrize("value, kept", [("  KW-508 ", "KW-508"), ("n/a", None), ("N.A.", None), ("k. A.", None), ("--", None), ("?", None), (" ", None), ("", None), (None, None), ("TBD", None), ("unbekannt", None), ("not given", None), ("null", None), ("Ö", "Ö"), ("0", "0")])
def test_values(spark, value, kept):
    assert spark.createDataFrame([(value,)], "v string").select(known(F.col("v"))).first()[0] == kept


def test_trust_then_time(spark):
    rows = [("a", 1, {"m": "old", "t": "x"}, 1, 0), ("a", 2, {"m": "new"}, 1, 5), ("a", 3, {"m": "newest", "t": "y"}, 2, 9), ("a", 4, {"t": "z"}, None, 99), ("b", 1, {"m": "alone"}, 1, 1), ("b", 1, {"m": "alone"}, 1, 1),
            ("c", 1, {"m": "n/a"}, 1, 1), ("c", 2, {"m": "kept"}, None, None), ("d", 1, {"m": "-"}, 1, 1), ("d", 2, None, 1, 1), (None, 1, {"m": "x"}, 1, 1), (None, 2, {"m": "x"}, 1, 1)]
    assert survive(spark, rows) == {("a", "m"): "new", ("a", "t"): "x", ("c", "m"): "kept"}
    assert survive(spark, []) == {}


def test_against_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(f"g{rng.randint(0, 30)}", i, {f: rng.choice(["v1", "v2", " v3 ", "n/a", None]) for f in ("p", "q") if rng.random() < 0.8}, rng.choice([1, 2, None]), i) for i in range(200)]
    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        for f in ("p", "q") if len(own) > 1 else ():
            best = max(((-(t if t is not None else 99), d, v.strip()) for _, _, m, t, d in own if (v := m.get(f)) and v != "n/a"), default=None)
            if best:
                want[g, f] = best[2]
    assert survive(spark, rows + rows[:9]) == want


def test_currency_where_times_are_missing(spark):
    # learned: analog was followed by digital in three groups
    history = [(f"h{i}", r, {"m": v}, 3, d) for i in range(3) for r, (v, d) in enumerate((("analog", 1), ("digital", 40)))]
    undated = [("u", 1, {"m": "digital"}, 1, None), ("u", 2, {"m": "analog"}, 1, None), ("u", 3, {"m": "analog"}, 1, None)]
    got = survive(spark, history + undated)
    assert got["u", "m"] == "digital" and got["h0", "m"] == "digital"
    # what the group itself dates as outdated loses; else the more frequent, then the greater
    got = survive(spark, [("u", 1, {"m": "x"}, 1, None), ("u", 2, {"m": "w"}, 1, None), ("u", 3, {"m": "x"}, 2, 1), ("u", 4, {"m": "w"}, 2, 2), ("n", 1, {"m": "p"}, 1, None), ("n", 2, {"m": "q"}, 1, None), ("n", 3, {"m": "p"}, 1, None), ("e", 1, {"m": "p"}, 1, 3), ("e", 2, {"m": "q"}, 1, 3)])
    assert (got["u", "m"], got["n", "m"], got["e", "m"]) == ("w", "p", "q")


def test_currency_over_values_between(spark):
    def followed(name, a, b):
        return [(name, 1, {"m": a}, 3, 1), (name, 2, {"m": b}, 3, 40)]

    chain = followed("h", "tube", "relay") + followed("i", "relay", "chip") + followed("j", "chip", "cloud")
    undated = [("u", 1, {"m": "tube"}, 1, None), ("u", 2, {"m": "tube"}, 1, None), ("u", 3, {"m": "cloud"}, 1, None), ("v", 1, {"m": "tube"}, 1, 7), ("v", 2, {"m": "chip"}, 1, 7)]
    got = survive(spark, chain + undated)
    assert (got["u", "m"], got["v", "m"]) == ("cloud", "chip")
    # a cycle orders nothing: the more frequent survives, then the greater
    got = survive(spark, chain + followed("k", "cloud", "tube") + undated)
    assert (got["u", "m"], got["v", "m"]) == ("tube", "tube")


def test_undated_and_dated_records_compete(spark):
    history = [(f"h{i}", r, {"m": v}, 3, d) for i in range(3) for r, (v, d) in enumerate((("old", 1), ("new", 40)))]
    rows = [("u", 1, {"m": "old"}, 1, 90), ("u", 2, {"m": "new"}, 1, None), ("v", 1, {"m": "new"}, 1, 90), ("v", 2, {"m": "old"}, 1, None), ("w", 1, {"m": "x"}, 1, 90), ("w", 2, {"m": "y"}, 1, None), ("t", 1, {"m": "old"}, 1, 90), ("t", 2, {"m": "new"}, 2, None)]
    got = survive(spark, history + rows)
    # learned: old before new; nothing is known of x and y, where a time counts; trust comes first
    assert [got[g, "m"] for g in "uvwt"] == ["new", "new", "x", "old"]


def test_current_values_with_times_hidden(spark):
    steps = ["v1", "v2", "v3"]
    rows = [(f"g{i}", r, {"m": v, "c": "same", "x": random.Random(f"{i}{r}").choice("ab")}, 1, 40 * r) for i in range(60) for r, v in enumerate(steps[i % 2 : 3 - (i % 3 == 0)])]
    df = spark.createDataFrame([(g, r, f, t, at(d), "clash", "clash") for g, r, f, t, d in rows], SCHEMA)
    got = current_fields(df, ["grp"], "rec", "fields", "at").collect()
    assert all(r["value"] == r["latest"] for r in got if r["field"] in ("m", "c")) and {r["n_values"] for r in got if r["field"] == "c"} == {1}
    assert {r["grp"] for r in got if r["field"] == "m"} == {g for g, *_ in rows if sum(x[0] == g for x in rows) > 1}
    assert current_fields(df.limit(0), ["grp"], "rec", "fields", "at").count() == 0


def test_precedence_over_slices(spark):
    rows = [("g", "f", v, at(d)) for v, d in (("a", 0), ("b", 1), ("a", 90), ("c", 200), ("c", 201))] + [("h", "f", "a", None)]
    df = spark.createDataFrame(rows, "grp string, field string, value string, at timestamp")
    for seconds in (3600, 86_400 * 30, 10**9):
        got = sorted((r["earlier"], r["later"]) for r in value_precedence(df, ["grp"], "field", "value", "at", slice_seconds=seconds).collect())
        assert got == [("a", "c")]  # a to b and back again cancel
