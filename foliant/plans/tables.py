"""Tables of a data directory by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.plans.storage import scan


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{table}.parquet")
