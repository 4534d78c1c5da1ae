import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grafloom.llm.mixing import mix, mix_rates
from grafloom.llm.packing import fill_report, pack, plan_packing
from grafloom.llm.tokens import VOCABULARY, encoding, token_counts

CAPS = {1: 8, 2: 16, 3: 32}


def loads(runs):
    """Tokens of each container, with the check that nothing overlaps."""
    held = defaultdict(list)
    for size, first, n, each, cap, base, at in runs:
        for i in range(n):
            held[cap, base + i // each].append((at + i % each * size, size))
    for (cap, _), parts in held.items():
        parts.sort()
        assert all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= cap
    return {k: sum(s for _, s in p) for k, p in held.items()}


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 32), st.integers(1, 40), max_size=20))
def test_every_item_has_its_place(histogram):
    runs, made = plan_packing(histogram, [8, 16, 32])
    placed = defaultdict(list)
    for size, first, n, *_ in runs:
        placed[size] += range(first, first + n)
    assert {s: sorted(r) for s, r in placed.items()} == {s: list(range(n)) for s, n in histogram.items() if s}
    held = loads(runs)
    assert {c: len([1 for k, _ in held if k == c]) for c in (8, 16, 32)} == made
    for size, *_, cap, _, _ in runs:
        assert size <= cap


def test_little_room_is_left():
    rng = random.Random(1)
    histogram = Counter(min(4096, int(rng.lognormvariate(5.5, 1.0)) + 1) for _ in range(20_000))
    runs, made = plan_packing(histogram, [512, 1024, 2048, 4096])
    used, room = sum(s * n for s, n in histogram.items()), sum(c * n for c, n in made.items())
    assert used / room > 0.99


def packed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, size int, container int")
    return pack(df, "doc_id", "n_tokens", CAPS, **more)


def test_pack(spark):
    rng = random.Random(2)
    sizes = {i: rng.choice([None, 0, 3, 3, 3, 3, 7, 8, 9, 16, 20, 31, 32, 33, 70]) for i in range(400)}
    out = packed(spark, [(i, n, 1, 1) for i, n in sizes.items()] + [(5, sizes[5], 1, 1)], salts=3, step_tokens=64)
    rows = out.collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
    for i, n in sizes.items():
        n = n or 0
        assert sum(k for _, k in pieces[i]) == n and len(pieces[i]) == max(1, -(-n // 32))
        assert sorted(pieces[i])[0][0] == 0 and all(k == 32 for _, k in sorted(pieces[i])[:-1])
    held = defaultdict(list)
    for r in rows:
        if r["n_tokens"]:
            held[r["container_kind"], r["container"]].append((r["position"], r["n_tokens"]))
        else:
            assert r["container"] is None and r["container_kind"] is None
    for (kind, _), parts in held.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= CAPS[kind]
    report = {r["container_kind"]: r for r in fill_report(out, CAPS).collect()}
    assert sum(r["tokens"] for r in report.values()) == sum(n or 0 for n in sizes.values())
    assert all(r["used"] <= 1 and r["most_in_step"] <= 64 for r in report.values())


def test_pack_edges(spark):
    assert packed(spark, []).count() == 0
    assert [r["container"] for r in packed(spark, [(1, None, 0, 0), (2, 0, 0, 0)]).collect()] == [None, None]
    assert packed(spark, [(1, 32 * 1000 + 1, 0, 0)]).count() == 1001


@pytest.mark.skipif(not __import__("os").path.exists(VOCABULARY), reason="no tokenizer")
def test_tokens(spark):
    df = spark.createDataFrame([(1, "Messung 44 ergab 26,4 A", "s"), (2, "", "s"), (3, None, None), (4, "x" * 50_000, "t"), (5, "<|endoftext|> 😀", "t")], "doc_id bigint, text string, source string")
    rows = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text", "source").collect()}
    assert rows[2] == rows[3] == 0 and rows[1] == len(encoding(VOCABULARY).encode_ordinary("Messung 44 ergab 26,4 A")) and rows[4] > 0 and rows[5] > 2


def test_rates():
    total, rates = mix_rates({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1), "none": (0.5, 1)})
    assert total == 400 and rates == {"a": 2.0, "b": 0.2}
    assert mix_rates({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 1)}, 4000)[1] == {"a": 2.0, "b": 1.0}
    assert mix_rates({}, {"a": (0.5, 2)}) == (0.0, {})


def mixed(spark, rows, targets, **more):
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, copies int")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_repeats int, tokens int")
    use, report = mix(docs, "doc_id", "source", "n_tokens", goals, **more)
    return {r["doc_id"]: r["copies"] for r in use.collect()}, {r["source"]: r for r in report.collect()}


def test_mix(spark):
    rng = random.Random(3)
    sources = {"a": 30, "b": 2000, "c": 500, None: 20, "untargeted": 10}
    rows = [(i, s, int(rng.lognormvariate(5, 1)) + 1, 0) for i, s in enumerate(s for s, n in sources.items() for _ in range(n))]
    rows += [(10_000, "b", 0, 0), (10_001, "c", None, 0)]
    targets = [("a", 0.2, 4, 0), ("b", 0.5, 1, 0), ("c", 0.3, 2, 0), ("absent", 0.1, 3, 0), (None, 0.4, 9, 0)]
    use, report = mixed(spark, rows + rows[:7], targets, salts=5, seed=1)
    assert set(use) == {r[0] for r in rows} and use[10_000] == use[10_001] == 0
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    for s, goal, most in (("a", 0.2, 4), ("b", 0.5, 1), ("c", 0.3, 2)):
        own = [use[i] for i, source, n, _ in rows if source == s and n]
        r = report[s]["expected_copies"]
        assert set(own) <= {int(r), int(r) + 1} and max(own) <= most and abs(sum(own) - r * len(own)) <= 1
        assert abs(report[s]["actual_share"] - goal) < 0.01
    assert report["a"]["expected_copies"] == 4.0 and report[None]["used_tokens"] == 0 and report["untargeted"]["target_share"] is None
    again, _ = mixed(spark, rows[::-1], targets, salts=5, seed=1)
    assert again == use and mixed(spark, rows, targets, salts=5, seed=2)[0] != use


def test_mix_edges(spark):
    targets = [("a", 1.0, 2, 0)]
    assert mixed(spark, [], targets) == ({}, {})
    assert mixed(spark, [(1, "b", 5, 0)], targets)[0] == {1: 0}
    use, report = mixed(spark, [(1, "a", 5, 0)], targets, total=7.5)
    assert use[1] in (1, 2) and report["a"]["actual_share"] == 1.0
