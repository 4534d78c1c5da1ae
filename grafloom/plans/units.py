"""Process parameters in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import UNITS, spelling
from ..operators.units import common_units
from ..sources.tables import table


def _common(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "process_parameters")
    return common_units(
        rows, "param_id", device=["source_system"], kind="parameter_type", name="name", unit="unit", description="description", source_text="source_text",
        value="nominal_value", others=["min_value", "max_value"], at="ingested_at",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    target = table(spark, d, "common_units").select("parameter_type", "common_unit")
    return (
        _common(spark, d).where("unit_from in ('named', 'chosen') and nominal_value is not null").join(target, "parameter_type").where("unit <> common_unit")
        .select("param_id", F.round(F.col("nominal_value") * 100).cast("bigint").alias("nominal_hundredths"))
    )


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    """Every parameter with its unit, also where it is only decoded, and how sure
    that is."""
    return _common(spark, d)


QUERIES = {"p4_found": p4_found, "p4_units": p4_units}

_VALUES = ", ".join(f"('{k}', '{u}', {f!r}, {o!r}, '{spelling(s)}')" for k, units in UNITS.items() for u, (f, o, names) in units.items() for s in names)
_FORMS = "|".join(sorted({s.replace(".", r"\.?").replace(" ", r"\s*").replace("/", r"\s*/\s*").replace("^", r"\^").replace("'", "''") for u in UNITS.values() for _, _, n in u.values() for s in n} | {"℃", "μm", r"N\s*/\s*mm2", r"m3\s*/\s*h", r"ft3\s*/\s*h", r"lbf\s*/\s*in2"}, key=lambda s: -len(s)))
_SPELL = "regexp_replace(replace(replace(lower(translate({}, 'μ²³⁻¹″·', 'µ23-1\"')), '℃', '°c'), '^', ''), '[\\s.]+', '', 'g')"

SQL = {
    "p4_found": f"""
with voc as (select distinct * from (values {_VALUES}) t(kind, unit, f, o, s)),
p as (select distinct on (param_id) *, lower(trim(regexp_replace(name, '\\s*(\\[[^\\]]*\\]|\\([^)]*\\)|\\s/\\s*\\S.*|\\sin\\s+\\S.*)\\s*$', ''))) base from process_parameters),
usual as (select base, arg_max(parameter_type, n) kind from (select base, parameter_type, count(*) n from p where parameter_type is not null group by all) group by 1),
k as (select p.*, coalesce(p.parameter_type, usual.kind) kind from p left join usual using (base)),
said as (
  select param_id, kind, nominal_value v, unit a, nullif(regexp_extract(name, '[\\[(]\\s*([^\\])]+?)\\s*[\\])]\\s*$', 1), '') b1, nullif(regexp_extract(name, '\\s(?:/|in)\\s*(\\S.*?)\\s*$', 1), '') b2,
    nullif(regexp_extract(description, '(?:Werte in|values in|recorded as|\\()\\s*([^)]+?)\\)?$', 1), '') c,
    nullif(regexp_extract(source_text, replace(regexp_replace(cast(nominal_value as varchar), '[.]0$', ''), '.', '[.,]') || '(?:[.,]?0*)\\s*({_FORMS})(?:$|[^\\w/])', 1, 'i'), '') d
  from k where nominal_value is not null and not isnan(nominal_value)),
hit as (
  select said.*, coalesce(va.unit, vb1.unit, vb2.unit, vc.unit, vd.unit) u from said
  left join voc va on va.kind = said.kind and va.s = {_SPELL.format("a")} left join voc vb1 on vb1.kind = said.kind and vb1.s = {_SPELL.format("b1")}
  left join voc vb2 on vb2.kind = said.kind and vb2.s = {_SPELL.format("b2")} left join voc vc on vc.kind = said.kind and vc.s = {_SPELL.format("c")}
  left join voc vd on vd.kind = said.kind and vd.s = {_SPELL.format("d")})
select param_id, cast(round((v - o) * f * 100) as bigint) nominal_hundredths
from hit join (select distinct kind, unit, f, o from voc) x on x.kind = hit.kind and x.unit = hit.u join common_units c on c.parameter_type = hit.kind where hit.u <> c.common_unit""",
}
