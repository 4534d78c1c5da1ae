import json

import pytest
from pyspark.sql import functions as F

from grafloom.schema import RECORDS, fields, problems, split_valid, struct_type, validated
from grafloom.sources.extract import ExtractorSettings, dump_dict, dump_json, extract, extract_list, extract_records, http_backend, rule_backend, system_prompt


def check(spark, record, *payloads, **more):
    df = spark.createDataFrame([(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)], "i int, payload string")
    return validated(df, "payload", record, **more).orderBy("i").collect()


def test_every_record_has_a_type():
    for name in RECORDS:
        assert len(struct_type(name).fields) == len(fields(name))
    assert struct_type("ProcedureExecution")["quality_checks"].dataType.elementType["step_execution"].dataType["step"].dataType["name"].dataType.simpleString() == "string"


def test_coercion(spark):
    rows = check(spark, "Step", {"name": "a", "step_number": "5", "is_critical": "yes"}, {"name": "a", "step_number": 5.0}, {"name": "a", "step_number": 5.5}, {"name": 5}, {"name": {"a": 1}}, {"name": "a", "is_critical": None}, {"step_type": "bogus"}, {"name": "a", "other": 1}, "no json", None, "[1]")
    bad = [list(r["violations"]) for r in rows]
    assert bad == [[], [], ["step_number: type"], ["name: type"], ["name: type"], ["is_critical: null"], ["name: missing", "step_type: domain"], [], ["json"], ["json"], ["json"]]
    assert (rows[0]["record"]["step_number"], rows[0]["record"]["is_critical"]) == (5, True)
    assert (rows[1]["record"]["step_number"], rows[1]["record"]["is_critical"]) == (5, False)
    assert rows[8]["record"] is None


def test_nested(spark):
    good = {"step": {"name": "weld"}, "executed_by": {"name": "Hans", "role": "operator"}, "tools_used": [{"name": "t"}], "started_at": "2024-10-11T14:30:00", "status": "completed"}
    rows = check(spark, "StepExecution", good, {"step": {}, "executed_by": "Hans", "tools_used": [{"name": None}, 3]})
    assert rows[0]["violations"] == [] and str(rows[0]["record"]["started_at"]) == "2024-10-11 14:30:00" and rows[0]["record"]["tools_used"][0]["name"] == "t"
    assert sorted(rows[1]["violations"]) == ["executed_by: type", "step.name: missing", "tools_used.name: null", "tools_used: type"]


def test_default_lists(spark):
    row = check(spark, "Action", {"name": "a"})[0]
    assert row["record"]["parameters"] == [] and row["violations"] == []


def test_quarantine(spark):
    df = spark.createDataFrame([('{"name": "a"}',), ("{}",)], "payload string")
    good, bad = split_valid(validated(df, "payload", "Tool"))
    assert (good.count(), bad.count()) == (1, 1)


def test_prompts():
    one, many = system_prompt("Tool").split("\n"), system_prompt("Tool", "English", many=True).split("\n")
    assert len(one) == 6 and len(many) == 7
    assert one[1] == "Extract a Tool from the given text." and many[1] == "Extract ALL Tool instances from the given text."
    assert many[3] == "The input text is in English." and many[6] == "If no Tool is found, return an empty list."


def test_extract_list(spark):
    df = spark.createDataFrame([(1, "Den Laserkopf Zephegard TX-872 neben Kaltunter KS-55 einstellen."), (2, None), (3, "nichts")], "id int, text string")
    good, bad = extract_list(df, "text", "Tool", rule_backend)
    assert [(r["id"], r["pos"], r["record"]["name"], r["record"]["model"]) for r in good.orderBy("id", "pos").collect()] == [(1, 0, "Zephegard TX-872", "TX-872"), (1, 1, "Kaltunter KS-55", "KS-55")]
    assert bad.count() == 0


def test_retries_and_single_records(spark):
    def flaky(text, prompt, record, settings, calls=[0]):  # noqa: B006 - counts the calls of a worker
        calls[0] += 1
        if calls[0] % 3:
            raise OSError("busy")
        return json.dumps({"name": text, "role": "boss" if text == "x" else None, "prompt": prompt})

    df = spark.createDataFrame([("a",), ("x",)], "text string").coalesce(1)
    good, bad = extract_records(df, "text", "Worker", flaky, ExtractorSettings(max_retries=3), prompt="own")
    assert [r["record"]["name"] for r in good.collect()] == ["a"]
    assert [r["violations"] for r in bad.collect()] == [["role: domain"]]
    assert [r["payload"] for r in extract(df, "text", "Worker", lambda *a: "no json").collect()] == [None, None]


def test_dump(spark):
    text = dump_json(spark.createDataFrame([("a", None)], "x string, y int"), "x", "y").first()[0]
    assert json.loads(text) == {"x": "a", "y": None} and "\n" in text


def test_runs(spark):
    from grafloom.operators.runs import compare_sizes, list_sizes, record_run, strategy_sweep

    df = spark.createDataFrame([(1, ["a"], None), (2, [], ["b", "c"])], "id int, p array<string>, q array<string>")
    assert [tuple(r) for r in list_sizes(df, "p", "q").orderBy("id").collect()] == [(1, 1, 0), (2, 0, 2)]
    same = compare_sizes(df.select("id", "p"), df.select("id", F.col("q").alias("p")), "id", "p").orderBy("id").collect()
    assert [(r["expected_p"], r["got_p"], r["same_p"]) for r in same] == [(1, 0, False), (0, 2, False)]
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, experiment_name string")
    metrics = spark.createDataFrame([(1, "x", 0.5)], "run_id int, category string, f1 double")
    assert {r["run_id"]: r["entity_metrics"] for r in record_run(runs, {"entity": metrics}).collect()} == {1: {"x": 0.5}, 2: None}
    e = spark.createDataFrame([("g", 0, "A b")], "grp string, pos int, name string")
    x = spark.createDataFrame([("g", 0, "a  B c")], "grp string, pos int, name string")
    assert {r["strategy"]: r["true_positives"] for r in strategy_sweep(e, x, "grp").collect()} == {"exact": 0, "normalized": 0, "token_overlap": 1}


@pytest.mark.parametrize("name", ["Tool", "ExperimentConfig"])
def test_empty_table(spark, name):
    df = spark.createDataFrame([], "payload string")
    assert validated(df, "payload", name).count() == 0


def test_both_checks_agree(spark):
    values = [
        {"name": "a", "step_number": "5", "is_critical": "yes"}, {"name": "a", "step_number": 5.5}, {"name": 5}, {"name": None}, {"name": "a", "is_critical": None}, {"step_type": "bogus", "is_critical": 3}, [], {"name": "a", "step_number": True},
    ]
    assert [sorted(r["violations"]) for r in check(spark, "Step", *values)] == [sorted(problems(v, "Step")) for v in values]
    values = [{"step": {}, "executed_by": "Hans", "tools_used": [{"name": None}, 3]}, {"step": {"name": "w"}, "executed_by": {"name": "H"}, "started_at": "2024-10-11T14:30:00", "status": "odd"}, {"step": {"name": "w"}, "executed_by": {"name": "H"}, "started_at": "when", "tools_used": {}}]
    assert [sorted(r["violations"]) for r in check(spark, "StepExecution", *values)] == [sorted(problems(v, "StepExecution")) for v in values]


def test_a_violation_is_asked_again(spark):
    def learns(text, prompt, record, settings, calls=[0]):  # noqa: B006 - counts the calls of a worker
        calls[0] += 1
        return json.dumps({"name": text, "role": "operator" if calls[0] > 1 else "boss"})

    df = spark.createDataFrame([("a",)], "text string")
    good, bad = extract_records(df, "text", "Worker", learns)
    assert (good.count(), bad.count()) == (1, 0)


def test_the_model_is_told_what_was_wrong(spark):
    def honest(text, prompt, record, settings):
        return json.dumps({"name": prompt.split("\n")[-1], "role": "boss"}) if "role: domain" not in prompt else json.dumps({"name": prompt.split("\n")[-1]})

    df = spark.createDataFrame([("a",)], "text string")
    good, bad = extract_records(df, "text", "Worker", honest)
    assert [r["record"]["name"] for r in good.collect()] == ["Your last answer did not fit (role: domain). Answer again, with these put right."] and bad.count() == 0
    silent = extract_records(df, "text", "Worker", lambda t, p, r, s: "oops" if "no JSON" not in p else json.dumps({"name": "b"}))[0]
    assert [r["record"]["name"] for r in silent.collect()] == ["b"]


def test_one_connection_is_kept(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Server(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"
        opened = 0

        def setup(self):
            Server.opened += 1
            super().setup()

        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            answer = json.dumps({"choices": [{"message": {"content": json.dumps({"name": "x"})}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(answer)))
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(str(i),) for i in range(20)], "text string").repartition(1)
    good, _ = extract_records(df, "text", "Tool", http_backend(f"http://127.0.0.1:{server.server_port}", timeout=10))
    assert good.count() == 20 and Server.opened == 1
    server.shutdown()
    with pytest.raises(OSError):
        http_backend("http://127.0.0.1:9", timeout=1)("t", "p", "Tool", ExtractorSettings())


def test_dict_dump(spark):
    row = spark.createDataFrame([((1, ["a"]),)], "r struct<x:int,y:array<string>>").first()
    assert dump_dict(row) == {"r": {"x": 1, "y": ["a"]}}


def test_executions_are_compared_and_flattened(spark):
    from grafloom.operators.runs import compare_executions, flatten_execution
    from grafloom.sources.gold_levels import LEVEL_5

    other = {k: v for k, v in LEVEL_5.items() if k not in ("feedback", "supervised_by")} | {"overall_result": "rejected"}
    df = spark.createDataFrame([(1, json.dumps(LEVEL_5), json.dumps(other))], "key int, a string, b string")
    expected, got = (validated(df.select("key", F.col(c).alias("payload")), "payload", "ProcedureExecution").select("key", "record") for c in "ab")
    row = compare_executions(expected, got, "key").first()
    assert (row["expected_step_executions"], row["got_step_executions"], row["same_step_executions"]) == (4, 4, True)
    assert (row["expected_feedback"], row["got_feedback"], row["same_feedback"], row["same_executed_by"]) == (1, 0, False, True)
    assert (row["expected_supervised_by"], row["got_supervised_by"], row["expected_overall_result"], row["got_overall_result"]) == ("Dr. Weber", None, "accepted_with_conditions", "rejected")
    rows = [(r["part"], r["pos"], r["name"], r["status"]) for r in flatten_execution(expected, "key").collect()]
    assert rows == [("step", 0, "Werkstück vorbereiten", "completed"), ("step", 1, "Heften", "completed"), ("step", 2, "Wurzellage", "completed"), ("step", 3, "Decklage", "completed"), ("check", 0, "Maria Schmidt", "pass"), ("feedback", 0, "Hans Müller", "question")]


def test_model_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            content = json.dumps({"items": [{"name": asked["messages"][1]["content"], "model": asked["model"]}]})
            answer = json.dumps({"choices": [{"message": {"content": content}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([("a torch",)], "text string")
    good, _ = extract_list(df, "text", "Tool", http_backend(f"http://127.0.0.1:{server.server_port}", timeout=10), ExtractorSettings(model="m"))
    assert [(r["record"]["name"], r["record"]["model"]) for r in good.collect()] == [("a torch", "m")]
    server.shutdown()


def test_nested_records_are_checked_to_their_full_depth(spark):
    from grafloom.schema import full_depth

    good = {"procedure": {"name": "p"}, "executed_by": [{"name": "h"}]}
    step = {"step": {"description": "no name"}, "executed_by": {"name": "h"}}
    check = {"inspector": {"name": "i"}, "requirement": {"name": "q"}, "step_execution": step}
    bad = good | {"quality_checks": [check, None], "feedback": [{"step_execution": step, "reported_by": {"name": "h"}, "feedback_type": "issue", "content": "c"}]}
    df = spark.createDataFrame([(1, json.dumps(bad), "kept", "gone")], "id int, payload string, x string, record string")
    row = validated(df, "payload", "ProcedureExecution").first()
    assert sorted(row["violations"]) == sorted(problems(bad, "ProcedureExecution")) == ["feedback.step_execution.step.name: missing", "quality_checks.step_execution.step.name: missing", "quality_checks: type"]
    assert row["record"]["quality_checks"][0]["step_execution"]["executed_by"]["name"] == "h" and row["x"] == "kept"
    assert full_depth("ProcedureExecution") == 3 and full_depth("Tool") == 0
    assert validated(df, "payload", "ProcedureExecution", depth=1).first()["violations"] == ["quality_checks: type"]
