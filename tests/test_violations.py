"""Validation queries on fixtures, where SQL cannot follow."""

import json
from collections import Counter

from grafloom.plans.catalogue import QUERIES


def test_all_execution_violations(spark, tmp_path):
    step = {"step": {"name": "weld"}, "executed_by": {"name": "Hans"}}
    procedure = {"procedure": {"name": "p"}, "executed_by": [{"name": "Hans"}]}
    checked = {"inspector": {"name": "Ida"}, "requirement": {"name": "q"}, "step_execution": {"step": {"name": 5}, "executed_by": {"name": "Hans", "role": "boss"}}}
    rows = [
        (1, "StepExecution", step), (2, "StepExecution", step | {"observed_parameters": {}}), (3, "StepExecution", step | {"observed_parameters": [None, {"name": None}], "started_at": "when"}),
        (4, "ProcedureExecution", procedure), (5, "ProcedureExecution", procedure | {"executed_by": "Hans", "overall_status": "odd"}), (6, "ProcedureExecution", procedure | {"quality_checks": [checked]}),
        (7, None, {"step": {"name": "weld"}}), (8, None, procedure | {"step_executions": [{"step": {"name": "s"}, "executed_by": {}}]}), (9, "Other", step), (10, "ProcedureExecution", None), (1, "StepExecution", step),
    ]
    spark.createDataFrame([(i, t, p and json.dumps(p)) for i, t, p in rows], "record_id bigint, record_type string, payload string").write.parquet(f"{tmp_path}/execution_records.parquet")
    got = Counter(tuple(r) for r in QUERIES["execution_violations"](spark, str(tmp_path)).collect())
    assert got == Counter([
        (2, "observed_parameters: type"), (3, "observed_parameters: type"), (3, "observed_parameters.name: null"), (3, "started_at: type"), (5, "executed_by: type"), (5, "overall_status: domain"),
        (6, "quality_checks.step_execution.step.name: type"), (6, "quality_checks.step_execution.executed_by.role: domain"), (7, "record_type: missing"), (7, "executed_by: missing"),
        (8, "record_type: missing"), (8, "step_executions.executed_by.name: missing"), (9, "record_type: domain"), (10, "json"),
    ])


def test_parameters_are_checked_in_every_field(spark, tmp_path):
    fine = {"param_id": 1, "name": "a", "parameter_type": "force", "unit": "N", "nominal_value": "1.5", "min_value": float("nan"), "max_value": 2.0, "description": "d", "source_text": "s", "source_system": "x"}
    rows = [fine, fine | {"param_id": 2, "nominal_value": "many"}, fine | {"param_id": 3, "nominal_value": None, "name": None, "min_value": None}]
    types = "param_id bigint, name string, parameter_type string, unit string, nominal_value string, min_value double, max_value double, description string, source_text string, source_system string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], types)
    df.write.parquet(f"{tmp_path}/a/process_parameters.parquet")
    df.selectExpr("* except (max_value, description, source_text)", "array(max_value) max_value", "1 description", "true source_text").write.parquet(f"{tmp_path}/b/process_parameters.parquet")
    a, b = ({r["param_id"]: r["violations"] for r in QUERIES["schema_violations"](spark, f"{tmp_path}/{x}").collect()} for x in "ab")
    assert a == {1: "", 2: "nominal_value: type", 3: "name: missing"}
    assert b[1] == "description: type; source_text: type; max_value: type"
