"""Gold records: JSON lines of a text and what is to be extracted from it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import split_valid, validated
from ..session import ship_package
from .gold_levels import LEVELS


def read_gold(spark: SparkSession, path: str, record: str) -> tuple[DataFrame, DataFrame]:
    """(gold rows, quarantined rows) of JSON lines under path.

    A line is {"key": ..., "text": ..., "expected": one record or a list of
    them}. Gold rows: key, text, pos (the place in the list, 0 for a single
    record), record (a struct of the declared type). Lines without expected
    give no row; what does not fit the type is quarantined with its violations.
    """
    ship_package(spark)
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    expected = F.try_variant_get("v", "$.expected", "variant")
    many = F.try_variant_get(expected, "$", "array<variant>")
    items = F.when(F.schema_of_variant(expected).startswith("ARRAY"), many).otherwise(F.array(expected))
    rows = lines.where(expected.isNotNull()).select(
        F.try_variant_get("v", "$.key", "string").alias("key"), F.try_variant_get("v", "$.text", "string").alias("text"), F.posexplode(F.transform(items, lambda x: F.to_json(x))).alias("pos", "payload")
    )
    return split_valid(validated(rows, "payload", record))


def write_records(df: DataFrame, path: str, *columns: str) -> None:
    """The columns of each row as a JSON line, nulls kept."""
    df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


#: The record types that occur in the gold levels.
GOLD_TYPES = ("Tool", "Material", "Procedure", "Step", "StepOrder", "ToolRequirement", "StepExecution", "ProcedureExecution")


def gold_rows(spark: SparkSession) -> DataFrame:
    """(level, text, record_type, pos, payload) of the gold levels: what each
    text states, as JSON of a record type; pos counts the records of a level's
    list."""
    rows = [(level, text, kind, pos, json.dumps(record, ensure_ascii=False)) for level, text, lists in LEVELS for records in lists for pos, (kind, record) in enumerate(records)]
    return spark.createDataFrame(rows, "level int, text string, record_type string, pos int, payload string")
