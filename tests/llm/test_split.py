import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grafloom.llm.split import CUT_COST, boundaries, longest_run, parse_strategy, run_at, split_points, split_texts


@pytest.mark.parametrize("text, sizes", [
    ("fixed_500", (500, 0)), ("fixed_800_overlap_80", (800, 80)), ("overlap_50_sentence_700", (700, 50)), ("SEMANTIC_900_OVERLAP_45", (900, 45)), ("fixed_1.2k", (1200, 0)), ("recursive[650|65]", (650, 65)),
    ("fixed_300/overlap 15 %", (300, 45)), ("paragraph max=1500 overlap=10%", (1500, 150)), ("fixed-400,overlap:0", (400, 0)), ("sentence-600/ov60", (600, 60)), ("none", (None, 0)), (None, (None, 0)), ("", (None, 0)),
    ("heading", (None, 0)), ("1.500 / 150", (1500, 150)), ("2K", (2000, 0)), ("fixed 1,5k overlap 0.1k", (1500, 100)), ("500|500", (500, 0)), ("500 overlap 400", (500, 400)), ("10%", (None, 0)),
])
def test_strategies(text, sizes):
    assert parse_strategy(text) == sizes


def check(text, limit, overlap):
    pieces = split_points(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == "end"
    assert all(0 < b - a <= limit for a, b, _ in pieces) or not text
    assert all(a2 == max(0, b - overlap) and b2 > b for (_, b, _), (a2, b2, _) in zip(pieces, pieces[1:]))
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n#!é😀 ", max_size=300), st.integers(1, 60), st.integers(0, 70))
def test_any_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    pieces = check(text, limit, overlap)
    if len(text) > limit:
        assert any(run_at(text, b) > limit for _, b, k in pieces if k == "hard") == (longest_run(text) > limit)


def test_natural_boundaries():
    text = "One sentence here. " * 10
    assert {k for _, _, k in check(text, 60, 0)[:-1]} == {"sentence"}
    text = "\n\n".join(["word " * 9 + "end."] * 6)
    assert {k for _, _, k in check(text, 60, 0)[:-1]} == {"paragraph"}
    assert {k for _, _, k in check("a, " * 40, 20, 4)[:-1]} == {"clause"}


def test_hard_only_where_it_must():
    text = "word " * 5 + "x" * 95 + " word" * 5
    kinds = [k for _, _, k in check(text, 30, 5)]
    assert kinds.count("hard") >= 2 and longest_run(text) == 95
    assert "hard" not in [k for _, _, k in check("word " * 50, 30, 5)]


def test_abbreviations_end_no_sentence():
    at, kind = boundaries("Das ist d. h. ca. 3 mm. Dann Nr. 5 nehmen. Ende")
    names = [list(CUT_COST)[k] for k in kind]
    assert [p for p, k in zip(at, names) if k == "sentence"] == [24, 43]


def brute(text, limit, overlap):
    """Fewest hard cuts over all ways to cut between words."""
    at, _ = boundaries(text)
    ends, best = [0, *at.tolist(), len(text)], {0: True}
    for e in ends[1:]:
        best[e] = any(best.get(s) and e - s <= (limit if s == 0 else limit - overlap) for s in ends if s < e)
    return best[len(text)]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc ", max_size=80), st.integers(4, 20))
def test_no_hard_cut_where_a_natural_way_exists(text, limit):
    overlap = limit // 4
    if len(text) > limit and brute(text, limit, overlap):
        assert all(k != "hard" for _, _, k in check(text, limit, overlap))


def cost_of(pieces, overlap, even):
    ends = [0, *(b for _, b, _ in pieces)]
    return sum(CUT_COST[k] for *_, k in pieces) + sum(6.0 * ((b - a - (overlap if a == 0 else 0)) / even - 1) ** 2 for a, b in zip(ends, ends[1:]))


def least_cost(text, limit, overlap, even):
    """Of all ways to cut at any boundary, one by one; None if there is none."""
    at, kind = boundaries(text)
    best = {0: 0.0}
    for e, c in [*zip(at.tolist(), (list(CUT_COST.values())[k] for k in kind)), (len(text), 0.0)]:
        ways = [best[s] + 6.0 * ((e - s - (overlap if s == 0 else 0)) / even - 1) ** 2 for s in best if e - s <= (limit if s == 0 else limit - overlap)]
        if ways:
            best[e] = min(ways) + c
    return best.get(len(text))


def test_cheapest_of_all_boundaries():
    rng = random.Random(5)
    better = 0
    for i in range(150):
        text = "".join("word" * rng.randint(1, 2) + rng.choice([" "] * rng.choice([6, 40]) + [", ", ". Then ", "\n", "\n\n"]) for _ in range(rng.randint(20, 150)))
        limit, overlap = rng.choice([(120, 0), (200, 20), (300, 60)])
        even = (len(text) - overlap) / math.ceil((len(text) - overlap) / (limit - overlap))
        pieces = check(text, limit, overlap)
        if len(text) > limit and (least := least_cost(text, limit, overlap, even)) is not None:
            assert cost_of(pieces, overlap, even) == pytest.approx(least), i
            better += any(k in ("clause", "space") for *_, k in pieces)
    assert better > 5


def test_long_texts_are_cut_whole():
    assert check("x" * 300_000, 800, 80)[0][2] == "hard"
    assert len(check("lorem ipsum dolor. " * 20_000, 800, 80)) > 500


def test_rows(spark):
    rows = [(1, "aaaa bbbb cccc", 9, 0, 7), (2, None, 9, 0, 7), (3, "", 9, 0, 7), (4, "short", 9, 0, 7), (5, "no limit " * 9, None, None, 7), (6, "x" * 20, 9, None, 7), (7, "😀" * 9, 9, 0, 7)]
    df = spark.createDataFrame(rows, "result_id bigint, source_chunk string, size int, ov int, piece int")
    got = split_texts(df, "result_id", "source_chunk", "size", "ov")
    assert {(r["result_id"], r["hard"]) for r in got.collect()} == {(1, 0), (6, 1)}
    assert [r["text"] for r in got.where("result_id = 1").orderBy("piece").collect()] == ["aaaa ", "bbbb cccc"]
    assert split_texts(df.limit(0), "result_id", "source_chunk", "size", "ov").count() == 0
