"""The record types, their Spark types, and the check of JSON against them.

A record type is declared once, as text; its StructType, its defaults and its
violations follow from the declaration. JSON is parsed to VARIANT, so that a
missing key, an explicit null and a value of another type stay apart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Value domains.
ENUMS = {
    "role": ["operator", "supervisor", "quality_inspector", "maintenance", "trainee", "welding_engineer"],
    "expertise": ["apprentice", "skilled", "expert", "master"],
    "step_type": ["preparation", "execution", "inspection", "cleanup", "documentation", "safety_check"],
    "procedure_status": ["draft", "approved", "active", "deprecated", "archived"],
    "procedure_domain": ["welding", "assembly", "inspection", "maintenance", "surface_treatment", "bending", "laser_cutting"],
    "parameter_type": ["temperature", "pressure", "speed", "current", "voltage", "flow_rate", "force", "time", "distance"],
    "requirement_type": ["dimensional", "visual", "destructive_test", "non_destructive_test", "documentation", "traceability"],
    "execution_status": ["completed", "failed", "skipped", "partially_completed", "interrupted"],
    "check_result": ["pass", "fail", "conditional", "not_inspected"],
    "feedback_type": ["question", "issue", "suggestion", "observation"],
    "severity": ["info", "warning", "critical"],
    "overall_status": ["completed", "completed_with_deviations", "failed", "aborted"],
    "overall_result": ["accepted", "accepted_with_conditions", "rejected", "pending_review"],
    "action_type": ["preparation", "manipulation", "inspection", "measurement", "assembly", "disassembly", "cleaning", "safety_check", "documentation", "other"],
    "object_role": ["input", "output", "target", "support", "unknown"],
}

# Record -> (what it is, own fields). A field is name:type; '!'
# marks a required one, '=' a default, '[...]' a list; str int float bool time
# are scalars, a lower-case name is a domain, a capitalised one a record. The
# fields of ENTITY or RELATION come in front.
ENTITY = "name:str! description:str source_text:str"
RELATION = "source_text:str"
RECORDS = {
    "Tool": ("A tool or instrument.", f"{ENTITY} tool_type:str manufacturer:str model:str"),
    "Material": ("A material or consumable.", f"{ENTITY} material_type:str specification:str dimensions:str"),
    "PPE": ("Personal protective equipment.", f"{ENTITY} ppe_type:str standard:str"),
    "Worker": ("A person who does or supervises work.", f"{ENTITY} role:role expertise_level:expertise certifications:[str]"),
    "Step": ("A step as it is specified.", f"{ENTITY} step_number:int expected_duration_seconds:int is_critical:bool=false step_type:step_type"),
    "Procedure": ("A procedure as it is specified.", f"{ENTITY} procedure_id:str version:str status:procedure_status domain:procedure_domain applicable_norms:[str]"),
    "ProcessParameter": ("A measurable parameter.", f"{ENTITY} parameter_type:parameter_type unit:str nominal_value:float min_value:float max_value:float"),
    "QualityRequirement": ("A criterion of quality.", f"{ENTITY} requirement_type:requirement_type acceptance_criteria:str inspection_method:str applicable_norm:str"),
    "StepOrder": ("One step comes before another.", f"{RELATION} before:Step! after:Step!"),
    "ProcedureHasStep": ("A procedure contains a step.", f"{RELATION} procedure:Procedure! step:Step!"),
    "ToolRequirement": ("A step needs a tool.", f"{RELATION} step:Step! tool:Tool! is_mandatory:bool=true configuration_notes:str parameters:[ProcessParameter]"),
    "MaterialRequirement": ("A step needs a material.", f"{RELATION} step:Step! material:Material! quantity:str preparation_notes:str"),
    "PPERequirement": ("A step needs protective equipment.", f"{RELATION} step:Step! ppe:PPE! is_mandatory:bool=true reason:str"),
    "StepExecution": ("A step as it was done.", f"{RELATION} step:Step! executed_by:Worker! tools_used:[Tool] materials_used:[Material] started_at:time ended_at:time actual_duration_seconds:int status:execution_status observed_parameters:[ProcessParameter] deviation_from_spec:str"),
    "QualityCheck": ("A check of a step that was done.", f"{RELATION} inspector:Worker! step_execution:StepExecution! requirement:QualityRequirement! result:check_result findings:str corrective_action_required:bool=false corrective_action_description:str inspected_at:time"),
    "QualificationRecord": ("What a worker is qualified for.", f"{RELATION} worker:Worker! expertise_level:expertise! procedure_domain:str! certifying_body:str certification_norm:str valid_from:time valid_until:time certificate_id:str"),
    "StepFeedback": ("A remark on a step that was done.", f"{RELATION} step_execution:StepExecution! reported_by:Worker! feedback_type:feedback_type! content:str! severity:severity resolved:bool=false resolution:str resolved_by:Worker"),
    "ProcedureExecution": ("A procedure as it was done.", f"{RELATION} procedure:Procedure! executed_by:[Worker]! supervised_by:Worker started_at:time ended_at:time step_executions:[StepExecution] quality_checks:[QualityCheck] feedback:[StepFeedback] overall_status:overall_status overall_result:overall_result procedure_version:str"),
    "Provenance": ("Where something was seen.", "video_id:str segment_id:str frame_start:int frame_end:int timestamp_start_seconds:float timestamp_end_seconds:float source_text:str confidence:float"),
    "Scene": ("A stretch of a video.", f"{ENTITY} video_id:str segment_id:str timestamp_start_seconds:float timestamp_end_seconds:float location:str confidence:float"),
    "SceneObject": ("An object in a scene.", f"{ENTITY} object_type:str state:str confidence:float provenance:Provenance"),
    "Action": ("Something done in a scene.", f"{ENTITY} action_type:action_type actor:Worker scene:Scene sequence_index:int timestamp_start_seconds:float timestamp_end_seconds:float parameters:[ProcessParameter]= confidence:float provenance:Provenance"),
    "UsesTool": ("An action uses a tool.", f"{RELATION} action:Action! tool:Tool! confidence:float provenance:Provenance"),
    "ActsOnObject": ("An action acts on an object.", f"{RELATION} action:Action! object:SceneObject! role:object_role confidence:float provenance:Provenance"),
    "ActionOrder": ("One action comes before another.", f"{RELATION} before:Action! after:Action! confidence:float provenance:Provenance"),
    "ActionCauses": ("One action brings about another.", f"{RELATION} cause:Action! effect:Action! rationale:str confidence:float provenance:Provenance"),
    "ActionPartOfProcedure": ("An action belongs to a procedure.", f"{RELATION} action:Action! procedure:Procedure! confidence:float provenance:Provenance"),
    "ActionObservedInScene": ("An action is seen in a scene.", f"{RELATION} action:Action! scene:Scene! confidence:float provenance:Provenance"),
    "EgocentricVideoExtraction": ("All that was extracted from one video.", "video_id:str source_text:str scenes:[Scene]= procedures:[Procedure]= actors:[Worker]= actions:[Action]= tools:[Tool]= objects:[SceneObject]= parameters:[ProcessParameter]= uses_tool:[UsesTool]= acts_on_object:[ActsOnObject]= action_order:[ActionOrder]= action_causes:[ActionCauses]= part_of_procedure:[ActionPartOfProcedure]= observed_in_scene:[ActionObservedInScene]="),
    "ExtractionResult": ("What was extracted from one chunk.", "entities:[str]= relations:[str]= source_chunk:str extraction_model:str extraction_timestamp:time"),
    "ExperimentConfig": ("The setting of one run.", "experiment_name:str! domain:str! schema_level:int! model:str! prompt_strategy:str! temperature:float=0.0 notes:str timestamp:time chunking_strategy:str finetuning_dataset:str num_few_shot_examples:int"),
}

_SCALARS = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "time": T.TimestampNTZType()}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str
    many: bool
    required: bool
    default: str | None  # '' is an empty list

    @property
    def data_type(self) -> T.DataType:
        own = _SCALARS.get(self.kind) or (T.StringType() if self.kind in ENUMS else struct_type(self.kind))
        return T.ArrayType(own) if self.many else own


@lru_cache(maxsize=None)
def fields(record: str) -> tuple[FieldSpec, ...]:
    out = []
    for part in RECORDS[record][1].split():
        name, kind = part.split(":")
        kind, eq, default = kind.partition("=")
        required = kind.endswith("!")
        kind = kind.rstrip("!")
        out.append(FieldSpec(name, kind.strip("[]"), kind.startswith("["), required, default if eq else None))
    return tuple(out)


@lru_cache(maxsize=None)
def struct_type(record: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.data_type) for f in fields(record)])


@lru_cache(maxsize=None)
def full_depth(record: str) -> int:
    """How deep records nest in a record."""
    return max((1 + full_depth(f.kind) for f in fields(record) if f.kind in RECORDS), default=0)


def _is(kind: Column, *names: str) -> Column:
    return F.coalesce(kind.rlike(f"^({'|'.join(names)})"), F.lit(False))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_NONE = "array<string>"


def _checked(value: Column, violations: Column) -> Column:
    return F.struct(value.alias("v"), violations.alias("bad"))


def _scalar(v: Column, of: Column, kind: str) -> tuple[Column, Column]:
    """(value, fits) of a VARIANT that is not null: what a lax reader accepts."""
    text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    if kind == "str" or kind in ENUMS:
        return F.when(_is(of, "STRING"), text), _is(of, "STRING")
    if kind == "float":
        value = F.when(_is(of, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(F.coalesce(number, text.try_cast("double")))
        return value, value.isNotNull() & ~_is(of, "OBJECT", "ARRAY")
    if kind == "int":
        value = F.when(_is(of, "STRING"), F.when(F.trim(text).rlike(r"^[+-]?\d+(\.0+)?$"), text.try_cast("double"))).when(_is(of, "BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(number)
        whole = value.isNotNull() & (value == F.floor(value))
        exact = F.when(_is(of, "BIGINT"), F.try_variant_get(v, "$", "bigint")).otherwise(F.when(whole, value).try_cast("bigint"))
        return exact, F.coalesce(whole, F.lit(False))
    if kind == "bool":
        word = F.lower(text)
        value = F.when(word.isin("true", "t", "yes", "y", "on", "1", "1.0"), True).when(word.isin("false", "f", "no", "n", "off", "0", "0.0"), False)
        return value, value.isNotNull()
    value = F.coalesce(text.try_cast("timestamp_ntz"), F.when(_is(of, "BIGINT", "DECIMAL", "DOUBLE"), F.timestamp_seconds(number).try_cast("timestamp_ntz")))
    return value, value.isNotNull()


def _field(v: Column, f: FieldSpec, path: str, depth: int) -> Column:
    """struct(v, bad): value and violations of one field of the VARIANT object v."""
    at = f"{path}{f.name}"
    strict = f.default is not None  # has a default other than null: an explicit null is wrong
    none, shape = F.array().cast(_NONE), f.data_type.simpleString()

    def wrong(what: str) -> Column:
        return F.array(F.lit(f"{at}: {what}"))

    def check(raw: Column) -> Column:
        if not f.many:
            return _value(raw, f, at, depth)
        element = FieldSpec(f.name, f.kind, False, False, None)
        items = F.transform(F.try_variant_get(raw, "$", "array<variant>"), lambda x: _value(x, element, at, depth))
        each = _with(items, lambda i: _checked(F.transform(i, lambda x: x["v"]), F.flatten(F.transform(i, lambda x: x["bad"]))))
        return F.when(_is(F.schema_of_variant(raw), "ARRAY"), each).otherwise(_checked(F.lit(None).cast(shape), wrong("type")))

    default = F.lit(None).cast(shape) if not strict else F.array().cast(shape) if f.many else F.lit(f.default).cast(shape)
    absent = _checked(default, wrong("missing") if f.required else none)
    null = _checked(F.lit(None).cast(shape), wrong("null") if f.required or strict else none)
    return _with(
        F.try_variant_get(v, f"$.{f.name}", "variant"),
        lambda raw: F.when(raw.isNull(), absent).when(F.coalesce(F.schema_of_variant(raw) == "VOID", F.lit(False)), null).otherwise(check(raw)),
    )


def _value(v: Column, f: FieldSpec, at: str, depth: int) -> Column:
    none, shape = F.array().cast(_NONE), FieldSpec(f.name, f.kind, False, False, None).data_type.simpleString()
    if f.kind in RECORDS:
        inside = _checked(F.lit(None).cast(shape), none) if depth == 0 else _record(v, f.kind, f"{at}.", depth - 1)
        return F.when(_is(F.schema_of_variant(v), "OBJECT"), inside).otherwise(_checked(F.lit(None).cast(shape), F.array(F.lit(f"{at}: type"))))

    def scalar(b: Column) -> Column:
        value, fits = _scalar(b["v"], b["of"], f.kind)
        violations = F.when(~fits, F.array(F.lit(f"{at}: type")))
        if f.kind in ENUMS:
            violations = violations.when(~value.isin(ENUMS[f.kind]), F.array(F.lit(f"{at}: domain")))
        return _checked(value, violations.otherwise(none))

    return _with(F.struct(v.alias("v"), F.schema_of_variant(v).alias("of")), scalar)


def _record(v: Column, record: str, path: str, depth: int) -> Column:
    """struct(v, bad) of the VARIANT object v."""
    names = [f.name for f in fields(record)]
    built = F.struct(*(_field(v, f, path, depth).alias(f.name) for f in fields(record)))
    return _with(built, lambda b: _checked(F.struct(*(b[n]["v"].alias(n) for n in names)), F.flatten(F.array(*(b[n]["bad"] for n in names)))))


def validated(df: DataFrame, payload: str, record: str, *, depth: int | None = None) -> DataFrame:
    """df with columns record (a struct with the declared types and defaults)
    and violations (array of 'field: missing | null | type | domain').

    payload is JSON text. Text that is no JSON object has the single violation
    'json' and a null record; a null payload likewise. Records are checked as
    deep as their type nests; with a given depth, those nested deeper are
    checked for being objects, but not inside, and are null. Unknown keys are
    ignored.
    """
    kept = [c for c in df.columns if c not in ("record", "violations")]  # columns of these names are replaced
    rows = df.select(*kept, F.try_parse_json(F.col(payload)).alias("_v"))
    checked = _record(F.col("_v"), record, "", full_depth(record) if depth is None else depth)
    no_object = _checked(F.lit(None).cast(struct_type(record)), F.array(F.lit("json")))
    rows = rows.withColumn("_c", F.when(_is(F.schema_of_variant("_v"), "OBJECT"), checked).otherwise(no_object))
    return rows.select(*kept, F.col("_c.v").alias("record"), F.col("_c.bad").alias("violations"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without violations, quarantined rows)."""
    clean = F.size("violations") == 0
    return checked.where(clean), checked.where(~clean)


def _problem(value: object, f: FieldSpec, at: str) -> list[str]:
    if f.kind in RECORDS:
        return problems(value, f.kind, f"{at}.") if isinstance(value, dict) else [f"{at}: type"]
    if f.kind == "str" or f.kind in ENUMS:
        fits = isinstance(value, str)
        return ([] if f.kind == "str" or value in ENUMS[f.kind] else [f"{at}: domain"]) if fits else [f"{at}: type"]
    try:
        if f.kind == "bool":
            fits = isinstance(value, bool) or str(value).lower() in ("true", "false", "t", "f", "yes", "no", "y", "n", "on", "off", "1", "0", "1.0", "0.0")
        elif f.kind == "time":
            fits = datetime.fromisoformat(value) is not None if isinstance(value, str) else isinstance(value, (int, float))
        else:
            fits = isinstance(value, (bool, int, float, str)) and (f.kind == "float" and float(value) is not None or float(value).is_integer())
    except (ValueError, OverflowError):
        fits = False
    return [] if fits else [f"{at}: type"]


def problems(value: object, record: str, path: str = "") -> list[str]:
    """What validated() finds, for one decoded JSON value in a Python worker:
    there it decides whether a model is asked again."""
    if not isinstance(value, dict):
        return ["json"]
    out = []
    for f in fields(record):
        at = f"{path}{f.name}"
        if f.name not in value:
            out += [f"{at}: missing"] * f.required
        elif value[f.name] is None:
            out += [f"{at}: null"] * (f.required or f.default is not None)
        elif f.many:
            items = value[f.name]
            out += [p for x in items for p in ([f"{at}: type"] if x is None else _problem(x, f, at))] if isinstance(items, list) else [f"{at}: type"]
        else:
            out += _problem(value[f.name], f, at)
    return out
