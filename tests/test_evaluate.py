import random

import pytest
from pyspark.sql import functions as F

from grafloom.functions.matching import MatchStrategy
from grafloom.functions.metrics import format_prf1, format_prf1_table, micro_average, prf1, with_prf1
from grafloom.operators.assign import candidates, components, greedy
from grafloom.operators.evaluate import attributes, default_fields, entity_detection, evaluate_level, level_pairs, relation_detection


def records(spark, groups):
    return spark.createDataFrame([(g, i, n) for g, names in groups.items() for i, n in enumerate(names)], "grp string, pos int, name string")


def statuses(log):
    return sorted(r["status"] for r in log.collect())


def test_tools_two_of_three(spark):
    log = entity_detection(records(spark, {"t": ["TIG torch", "grinder", "caliper"]}), records(spark, {"t": ["TIG torch", "grinder"]}), "grp")
    assert statuses(log) == ["FN", "TP", "TP"]
    m = prf1(log, "grp").first()
    assert (m["precision"], m["recall"], m["f1"]) == (1.0, 0.6667, 0.8)
    assert log.where("status = 'FN'").first()["score"] == 0.0


def test_order_decides(spark):
    e, x = ["a b", "a b c d"], ["a b c d", "a b"]
    assert statuses(entity_detection(records(spark, {"g": e}), records(spark, {"g": x}), "grp")).count("TP") == 1
    assert statuses(entity_detection(records(spark, {"g": e[::-1]}), records(spark, {"g": x}), "grp")).count("TP") == 2


def by_hand(expected, extracted, threshold):
    def score(e, x):
        if e is None or x is None:
            return float(e is None and x is None)
        a, b = set(e.lower().split()), set(x.lower().split())
        return float(not b) if not a else len(a & b) / len(a)

    used, out = set(), []
    for i, e in enumerate(expected):
        best, at = 0.0, None
        for j, x in enumerate(extracted):
            if j not in used and score(e, x) > best:
                best, at = score(e, x), j
        hit = at is not None and best >= threshold
        if hit:
            used.add(at)
        out.append((i, at if hit else None, round(best, 3)))
    return out


@pytest.mark.parametrize("fold_limit", [10**9, 4, 0])
def test_greedy_against_a_plain_loop(spark, fold_limit):
    rng = random.Random(5)
    words = "ab cd ef gh".split()
    name = lambda: rng.choice([None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(6))])
    groups = [f"g{i}" for i in range(40)]
    e, x = ({g: [name() for _ in range(rng.randint(1, 7))] for g in groups} for _ in range(2))
    de, dx = records(spark, e), records(spark, x)
    got = greedy(candidates(de, dx, "grp", "name", all_pairs=fold_limit > 0), "grp", 0.5, fold_limit=fold_limit).collect()
    found = {(r["grp"], r["e"]): (r["x"], round(r["score"], 3)) for r in got}
    for g in groups:
        for i, j, s in by_hand(e[g], x[g], 0.5):
            assert found.get((g, i), (None, 0.0)) == (j, s)


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_rarest_tokens_find_all_near_pairs(spark, least):
    rng = random.Random(6)
    words = "the the the ab cd ef gh ij".split()
    name = lambda: rng.choice([None, "", *(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(8))])
    e, x = (records(spark, {g: [name() for _ in range(25)] for g in "gh"}) for _ in range(2))
    rows = lambda df: sorted((r["grp"], r["e"], r["x"], round(r["score"], 9)) for r in df.collect())
    assert rows(candidates(e, x, "grp", "name", least=least)) == rows(candidates(e, x, "grp", "name").where(F.col("score") >= least))
    quick = entity_detection(e, x, "grp", threshold=least, miss_scores=False).select("grp", "e", "x", "status")
    assert quick.exceptAll(entity_detection(e, x, "grp", threshold=least).select("grp", "e", "x", "status")).count() == 0


def test_components(spark):
    pairs = [("g", i, i) for i in range(20)] + [("g", i, i + 1) for i in range(19) if i != 9] + [("h", 5, 1), ("h", 3, 1)]
    got = {(r["grp"], r["e"]): r["comp"] for r in components(spark.createDataFrame(pairs, "grp string, e int, x int"), "grp").collect()}
    assert got == {("g", i): 0 if i < 10 else 10 for i in range(20)} | {("h", 5): 3, ("h", 3): 3}


def test_shortcut_equals_greedy(spark):
    rng = random.Random(1)
    groups = {f"g{i}": [rng.choice(["A", "a ", " b", "B", "c"]) for _ in range(8)] for i in range(20)}
    e, x = records(spark, groups), records(spark, {g: n[::-1] for g, n in groups.items()})
    short = entity_detection(e, x, "grp", strategy=MatchStrategy.NORMALIZED, threshold=1.0)
    plain = greedy(candidates(e, x, "grp", "name", strategy=MatchStrategy.NORMALIZED), "grp", 1.0)
    pairs = lambda df: sorted((r["grp"], r["e"], r["x"]) for r in df.where("e is not null and x is not null").collect())
    assert pairs(short) == pairs(plain)


def test_empty_sides(spark):
    none, some = records(spark, {}), records(spark, {"g": ["a", None]})
    assert statuses(entity_detection(some, none, "grp")) == ["FN", "FN"]
    assert statuses(entity_detection(none, some, "grp")) == ["FP", "FP"]
    assert statuses(entity_detection(none, none, "grp")) == []


def test_attributes(spark):
    df = spark.createDataFrame([(1, "TIG torch", "torch TIG", "Fronius", "Lorch", None, "x"), (2, None, None, "A", None, "m", "m")],
        "id int, expected_name string, extracted_name string, expected_maker string, extracted_maker string, expected_model string, extracted_model string")
    fields = ["name", "maker", "model"]
    rows = {(r["id"], r["field"]): r["status"] for r in attributes(df, fields).collect()}
    assert rows == {(1, "name"): "TP", (1, "maker"): "WRONG", (2, "maker"): "FN", (2, "model"): "TP"}
    explicit = {(r["id"], r["field"]): r["status"] for r in attributes(df, fields, explicit=True).collect()}
    assert explicit == rows | {(1, "model"): "FP"}
    m = prf1(attributes(df, fields)).first()
    assert (m["true_positives"], m["false_positives"], m["false_negatives"]) == (2, 0, 2)


def orders(spark, pairs):
    return spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(pairs)], "grp string, pos int, before string, after string")


def test_relations_match_by_the_mean_of_roles(spark):
    e = orders(spark, [("clean", "weld"), ("weld", "inspect")])
    assert statuses(relation_detection(e, orders(spark, [("clean", "weld")]), "grp", ["before", "after"])) == ["FN", "TP"]
    # 1.0 and 0.2 give 0.6; a missing player on both sides scores 1
    log = relation_detection(orders(spark, [("a", "a b c d e"), ("x", None)]), orders(spark, [("a", "a z"), ("x y", None)]), "grp", ["before", "after"])
    assert sorted((r["e"], r["x"], r["score"]) for r in log.collect()) == [(0, 0, 0.6), (1, 1, 1.0)]


def test_players_without_a_name_are_compared_as_text(spark):
    shape = "grp string, pos int, step struct<name:string,step_number:int>, who array<struct<name:string>>, how struct<kind:string>"
    e = spark.createDataFrame([("g", 0, ("weld", 1), [("Hans",)], ("fast",)), ("g", 1, None, [], None)], shape)
    x = spark.createDataFrame([("g", 0, ("weld", 2), [("Hans",)], ("slow",)), ("g", 1, None, [], None)], shape)
    log = relation_detection(e, x, "grp", ["step", "who", "how"])
    rows = sorted((r["e"], r["x"], r["score"], r["expected_step"], r["expected_who"]) for r in log.where("e is not null").collect())
    assert rows == [(0, 0, 0.667, "weld", None), (1, 1, 1.0, None, None)]
    assert statuses(relation_detection(e, x, "grp", [])) == ["FN", "FN", "FP", "FP"]
    assert default_fields("Tool") == ["name", "tool_type", "manufacturer", "model"]


def test_level_looks_pairs_up_by_name(spark):
    df = spark.createDataFrame([("g", 0, "A", "first"), ("g", 1, "A", "second")], "grp string, pos int, name string, tool_type string")
    log = entity_detection(df, df, "grp")
    pairs = level_pairs(log, df, df, "grp", ["tool_type"])
    assert [(r["expected_tool_type"], r["extracted_tool_type"]) for r in pairs.collect()] == [("first", "first")] * 2


def test_metrics(spark):
    df = spark.createDataFrame([("a", 2, 1, 1), ("z", 0, 0, 0), ("r", 1, 31, 0)], "category string, true_positives int, false_positives int, false_negatives int")
    m = {r["category"]: r for r in with_prf1(df).collect()}
    assert (m["a"]["precision"], m["a"]["recall"], m["a"]["f1"]) == (0.6667, 0.6667, 0.6667)
    assert (m["z"]["precision"], m["z"]["f1"], m["z"]["total_expected"]) == (0.0, 0.0, 0)
    assert m["r"]["precision"] == 0.0313
    assert {r["category"]: r["precision"] for r in with_prf1(df, python_rounding=True).collect()}["r"] == 0.0312
    overall = micro_average(df).first()
    assert (overall["true_positives"], overall["false_positives"], overall["total_extracted"]) == (3, 32, 35)
    assert micro_average(df.limit(0)).first()["f1"] == 0.0
    line = with_prf1(df).where("category = 'a'").select(format_prf1()).first()[0]
    assert line == f"{'a':30s} | P=0.667 R=0.667 F1=0.667 | TP=2 FP=1 FN=1"
    text = format_prf1_table(with_prf1(df), "T")
    assert text.count("\n") == 9 and "=" * 80 in text and "  T" in text


def test_embeddings(spark):
    e = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [0.0, 1.0])], "grp string, pos int, v array<double>")
    x = spark.createDataFrame([("g", 0, [0.0, 2.0]), ("g", 1, [3.0, 0.1])], "grp string, pos int, v array<double>")
    found = greedy(candidates(e, x, "grp", "v", strategy=MatchStrategy.EMBEDDING), "grp", 0.9)
    assert sorted((r["e"], r["x"]) for r in found.select("e", "x").where(F.col("x").isNotNull()).collect()) == [(0, 1), (1, 0)]


def test_a_whole_level(spark):
    df = spark.createDataFrame([("g", 0, "TIG torch", "welding", "Tool"), ("h", 0, "saw", None, "Tool")], "grp string, pos int, name string, tool_type string, type string")
    r = orders(spark, [("clean", "weld")])
    out = evaluate_level(df, df.where("grp = 'g'"), "grp", ["tool_type"], r, r, ["before", "after"])
    assert {(m["grp"], m["category"]): m["f1"] for m in out["entity_metrics"].collect()} == {("g", "Tool"): 1.0, ("h", "Tool"): 0.0}
    assert [(m["category"], m["true_positives"]) for m in out["attribute_metrics"].collect()] == [("attrs:TIG torch", 1)]
    assert [m["f1"] for m in out["relation_metrics"].collect()] == [1.0]
    assert evaluate_level(df, df, "grp", ["tool_type"], r, r.limit(0), ["before", "after"])["relation_metrics"].count() == 0
    assert "relation_log" not in evaluate_level(df.drop("type"), df, "grp", ["tool_type"])
    assert {m["category"] for m in evaluate_level(df.drop("type"), df, "grp", ["tool_type"])["entity_metrics"].collect()} == {"Unknown"}


def test_names_by_an_encoder(spark):
    from grafloom.sources.embed import hash_encoder, with_vectors

    e, x = records(spark, {"g": ["Fronius TPS 400i torch", "caliper", None]}), records(spark, {"g": ["calliper", "torch Fronius TPS400i", "saw"]})
    log = entity_detection(*(with_vectors(d, "name", "v", hash_encoder()) for d in (e, x)), "grp", "v", MatchStrategy.EMBEDDING, 0.6)
    assert sorted((r["e"], r["x"]) for r in log.where("status = 'TP'").collect()) == [(0, 1), (1, 0)]
    assert [len(v) for v in hash_encoder(8)(["", "a"])] == [8, 8] and with_vectors(e.limit(0), "name", "v", hash_encoder()).count() == 0


def test_order_of_a_table(spark):
    df = with_prf1(spark.createDataFrame([("z", 1, 0, 0, 0), ("a", 1, 0, 0, 1)], "category string, true_positives int, false_positives int, false_negatives int, pos int"))
    lines = format_prf1_table(df, order="pos").split("\n")
    assert lines[6].startswith("z ") and lines[7].startswith("a ")
