"""Readers for a folder that holds one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.plans.ship import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, *names: str) -> None:
    """Make the tables visible to spark.sql under their own names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
