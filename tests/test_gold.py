import json

from grafloom.functions.metrics import prf1
from grafloom.operators.evaluate import entity_detection
from grafloom.sources.gold import gold_rows, read_gold, write_records


def lines(path, *rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) if not isinstance(r, str) else r for r in rows))
    return str(path)


def test_lists_of_entities(spark, tmp_path):
    tools = [{"name": "Fronius TPS 400i", "tool_type": "welding"}, {"name": "Winkelschleifer"}, {"tool_type": "no name"}]
    good, bad = read_gold(spark, lines(tmp_path / "g.jsonl", {"key": "1", "text": "…", "expected": tools}, "broken", {"key": "2"}, {"key": "3", "expected": []}), "Tool")
    assert sorted((r["key"], r["pos"], r["record"]["name"]) for r in good.collect()) == [("1", 0, "Fronius TPS 400i"), ("1", 1, "Winkelschleifer")]
    assert [list(r["violations"]) for r in bad.collect()] == [["name: missing"]]
    e = good.select("key", "pos", "record.name")
    x = spark.createDataFrame([("1", 0, "MIG-Schweißgerät Fronius TPS 400i")], "key string, pos int, name string")
    assert prf1(entity_detection(e, x, "key")).first()["f1"] == 0.6667


def test_a_deep_record(spark, tmp_path):
    worker, step = {"name": "Hans", "role": "operator"}, {"name": "root pass", "step_number": 3}
    done = {"step": step, "executed_by": worker, "status": "completed", "actual_duration_seconds": 720, "observed_parameters": [{"name": "current", "unit": "A", "nominal_value": 185}]}
    record = {
        "procedure": {"name": "T-joint", "domain": "welding"}, "executed_by": [worker], "started_at": "2024-10-11T14:30:00", "step_executions": [done],
        "quality_checks": [{"inspector": {"name": "Maria"}, "step_execution": done, "requirement": {"name": "visual", "requirement_type": "visual"}, "result": "pass"}], "overall_status": "completed",
    }
    good, bad = read_gold(spark, lines(tmp_path / "d.jsonl", {"key": "5", "text": "t", "expected": record}), "ProcedureExecution")
    assert bad.count() == 0
    r = good.first()["record"]
    check = r["quality_checks"][0]
    assert r["step_executions"][0]["observed_parameters"][0]["nominal_value"] == 185.0 and check["corrective_action_required"] is False and check["step_execution"]["step"]["step_number"] == 3
    write_records(good, str(tmp_path / "out"), "key", "record")
    again = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert again["record"]["procedure"]["name"] == "T-joint" and again["record"]["supervised_by"] is None


def test_gold_levels(spark):
    from pyspark.sql import functions as F

    from grafloom.operators.evaluate import evaluate_level
    from grafloom.schema import validated

    rows = gold_rows(spark)
    assert {r["level"]: r["count"] for r in rows.groupBy("level").count().collect()} == {1: 3, 2: 8, 3: 1, 4: 1, 5: 1}
    tools = validated(rows.where("record_type = 'Tool'"), "payload", "Tool").select(F.lit("g").alias("grp"), "pos", "record.*")
    found = spark.createDataFrame([("g", 0, "MIG-Schweißgerät Fronius TPS 400i", "welding", None, "TPS 400i")], "grp string, pos int, name string, tool_type string, manufacturer string, model string")
    orders = validated(rows.where("record_type = 'StepOrder'"), "payload", "StepOrder").select(F.lit("g").alias("grp"), "pos", "record.before", "record.after")
    out = evaluate_level(tools, found, "grp", "Tool", orders, orders.where("pos < 2"), ["before", "after"], relation_type="StepOrder")
    assert [(m["category"], m["true_positives"], m["false_negatives"]) for m in out["attribute_metrics"].collect()] == [("attrs:Fronius TPS 400i", 3, 1)]
    assert [(m["category"], m["true_positives"], m["false_negatives"], m["false_positives"]) for m in out["relation_metrics"].collect()] == [("StepOrder", 2, 1, 0)]
    assert out["entity_metrics"].first()["f1"] == 1.0
