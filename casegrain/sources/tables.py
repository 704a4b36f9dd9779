"""Table access by name inside a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the dataset folder ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")
