"""Reading the parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
