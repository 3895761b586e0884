"""Parquet tables of one directory."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of the directory ``root``; columns are pruned and filters pushed by the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
