"""Readers for the parquet tables a query works on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet`` through Spark's reader, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
