import itertools
import random

import numpy as np
import pytest

from grafloom.functions.units import UNITS, annotation, last_mention, mentions_at_value, named_units, unit_of
from grafloom.operators.units import _emission, common_units, decode, moves, steps


@pytest.mark.parametrize("text, kind, unit", [
    ("deg. C", "temperature", "°C"), ("℃", "temperature", "°C"), ("KPA", "pressure", "kPa"), ("kPa ", "pressure", "kPa"), ("lbf/in²", "pressure", "psi"), ("mm·s⁻¹", "speed", "mm/s"), ("m/Min.", "speed", "m/min"),
    ("μm", "distance", "µm"), ("µm", "distance", "µm"), ("″", "distance", "in"), ("V.", "voltage", "V"), ("l / min", "flow_rate", "l/min"), ("n/a", "time", None), ("", "time", None), (None, "time", None), ("bar", "time", None), ("bar", None, "bar"),
])
def test_spellings(text, kind, unit):
    assert (unit_of(text, kind) or (None, None))[1] == unit


def test_every_spelling_is_of_one_unit():
    for kind, units in UNITS.items():
        for unit, (_, _, names) in units.items():
            assert all(unit_of(n, kind) == (kind, unit) for n in names)
        assert list(units.values())[0][:2] == (1.0, 0.0)


@pytest.mark.parametrize("text, value, kind, unit", [
    ("After 19 min the temperature read 154.8 C", 154.8, "temperature", "°C"), ("Regal 31: 0,0672 N/mm² gas pressure", 0.0672, "pressure", "MPa"), ("Blechdicke: 631688um", 631688.0, "distance", "µm"),
    ("Haltezeit 286,2, station 22", 286.2, "time", None), ("After 11 s the hold time was checked", 40.0, "time", None), ("After 11 s the hold time read 3.2 min", 3.2, "time", "min"), ("travel speed: 0.1015m/s", 0.1015, "speed", "m/s"),
    ("read 1.234,5 mm here", 1234.5, "distance", "mm"), ("5.2, in bay 3", 5.2, "distance", None), (None, 1.0, "time", None), ("12 a hot one", 12.0, "current", None), ("3 m", float("nan"), "distance", None),
])
def test_unit_at_the_value(text, value, kind, unit):
    assert [u for _, u in mentions_at_value(text, value, kind)] == [unit] * (unit is not None)


def test_order_of_places():
    assert named_units("-", "gap [mm]", "all values in inch", None, 1.0, "distance") == ("distance", ["mm"])
    assert named_units("n/a", "flow / l/h", None, None, 1.0, "flow_rate") == ("flow_rate", ["l/h"])
    assert named_units(None, "gap", "all values in inch", "gap 1.0 cm", 1.0, "distance") == ("distance", ["in"])
    assert named_units("cm", "gap [mm]", None, None, 1.0, "distance") == ("distance", ["cm"])
    assert named_units(None, "gap", "values in mm, in the past in inch", None, 1.0, "distance") == ("distance", ["mm", "in"])
    assert named_units(None, "gap", None, "no unit", 1.0, "distance") is None
    assert last_mention("all values in mm", "distance") == ("distance", "mm")


@pytest.mark.parametrize("name, kind, unit", [
    ("wire feed in cm/min", "speed", "cm/min"), ("coolant flow in l / min", "flow_rate", "l/min"), ("flow in tank [l/h]", "flow_rate", "l/h"), ("bath in the hall", "temperature", None), ("hold time, s", "time", "s"), ("in", "distance", None), (None, "time", None),
])
def test_unit_in_the_name(name, kind, unit):
    assert (annotation(name, kind) or (None, None))[1] == unit


def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, device string, kind string, name string, unit string, description string, text string, v double, lo double, hi double, at timestamp, extra int")


def run(spark, data, **more):
    df = common_units(rows(spark, data), "id", device=["device"], kind="kind", name="name", unit="unit", description="description", source_text="text", value="v", others=["lo", "hi"], at="at", **more)
    return {r["id"]: r for r in df.collect()}


def row(i, unit, v, kind="pressure", name="line", lo=None, hi=None, device="d"):
    from datetime import datetime, timedelta

    return (i, device, kind, name, unit, None, None, v, lo, hi, datetime(2025, 1, 1) + timedelta(hours=i), 0)


def test_switches_of_the_unit_are_found(spark):
    rng = random.Random(3)
    truth = ["kPa"] * 30 + ["bar"] * 20 + ["kPa"] * 20 + ["psi"] * 15
    factor = {u: UNITS["pressure"][u][0] for u in set(truth)}
    level, data = 200.0, []
    for i, u in enumerate(truth):
        level *= 1 + rng.uniform(-0.02, 0.02)
        data.append(row(i, u if i % 10 == 0 else None, level / factor[u]))
    got = run(spark, data)
    assert [got[i]["unit"] for i in range(len(truth))] == truth
    assert all(abs(got[i]["v"] / 200 - 1) < 0.3 for i in got)
    assert {got[i]["unit_from"] for i in got} == {"named", "decoded"}
    # slices of any length give the path of the whole sequence
    for n in (3, 20):
        assert {i: r["unit"] for i, r in run(spark, data, slice_rows=n).items()} == {i: r["unit"] for i, r in got.items()}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n, k = 5, 3
        x, h = rng.normal(0, 1, (n, k)), rng.normal(-1, 1, (n, 2, k))
        x[rng.random((n, k)) < 0.1] = np.nan
        allowed = rng.choice([0, 0, 1, 2, 4, 3, 6], n)
        share = np.array([0.5, 0.3, 0.2])
        e, step = _emission(allowed, k), steps(moves(share, 0.3), x, h, 0.2, 0.6)

        def score(path):
            return np.log(share[path[0]]) + (0.0 if np.isnan(x[0][path[0]]) else h[0, :, path[0]].sum()) + sum(e[t][path[t]] for t in range(n)) + sum(step[t - 1][path[t - 1], path[t]] for t in range(1, n))

        paths = list(itertools.product(range(k), repeat=n))
        path, sure = decode(x, h, allowed, share, 0.3, 0.2, 0.6)
        assert score(tuple(path)) == pytest.approx(max(map(score, paths)))
        for t in range(n):
            through = [sum(np.exp(score(p)) for p in paths if p[t] == u) for u in range(k)]
            assert sure[t] == pytest.approx(through[path[t]] / sum(through))


def test_hidden_units_of_smooth_levels(spark):
    rng = random.Random(8)
    data, truth = [], {}
    for d in range(4):
        level, u = 200.0 * (d + 1), "kPa"
        for i in range(120):
            level *= 1 + rng.uniform(-0.03, 0.03)
            if rng.random() < 0.08:
                u = rng.choice(["kPa", "bar", "psi", "MPa"])
            truth[d * 1000 + i] = u
            data.append(row(d * 1000 + i, u if rng.random() < 0.5 else None, level / UNITS["pressure"][u][0], device=f"d{d}"))
    got = [r for r in run(spark, data).values() if r["unit_from"] != "named"]
    known = [r for r in got if r["unit"]]
    assert len(known) > 0.9 * len(got) and sum(truth[r["id"]] == r["unit"] for r in known) > 0.95 * len(known)


def test_levels_that_tell_nothing_leave_the_unit_unknown(spark):
    rng = random.Random(9)
    truth = {i: rng.choice(["kPa", "hPa", "psi"]) for i in range(600)}
    data = [row(i, u if i % 3 else None, float(f"{10 ** rng.uniform(0, 6):.4g}")) for i, u in truth.items()]
    got = [r for r in run(spark, data).values() if r["id"] % 3 == 0]
    assert sum(r["unit"] is None for r in got) > 180 and all(r["v"] is None for r in got if r["unit"] is None)


def test_a_text_that_names_several_units(spark):
    data = [row(i, "bar", 2.0 + i % 3) for i in range(30)]
    data[15] = (*data[15][:4], None, "values in kPa or bar", *data[15][6:])
    got = run(spark, data)[15]
    assert (got["unit"], got["unit_from"]) == ("bar", "chosen")


def test_edges(spark):
    data = [row(1, "°F", 212.0, "temperature", "bath"), row(2, "K", 273.15, "temperature", "bath"), row(3, "bar", None, lo=2.0, hi=1.0), row(4, "bar", float("nan")), row(5, None, 3.0, None, "nothing known"),
            row(6, "mm", 3.0, None, "also new"), row(7, "n/a", 0.0), row(8, "kPa", 1.0, None, "line"), row(9, "kPa", 1.0, "bogus", "line", device=None), row(10, "h", 2.0, "time", None)]
    got = run(spark, data + data[:2])
    assert got[1]["v"] == pytest.approx(100.0) and got[2]["v"] == pytest.approx(0.0)
    assert (got[3]["v"], got[3]["lo"], got[3]["hi"]) == (None, 100.0, 200.0) and got[4]["v"] is None
    assert (got[5]["unit"], got[5]["v"], got[5]["unit_from"]) == (None, None, None)
    assert (got[6]["kind"], got[6]["unit"]) == ("distance", "mm") and got[8]["kind"] == "pressure" and got[9]["kind"] == "pressure"
    assert got[10]["v"] == 7200.0 and (got[7]["v"], got[7]["unit"]) == (None, None)
    assert run(spark, []) == {}
