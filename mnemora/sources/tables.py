"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Parquet carries the schema, so nothing is inferred from rows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
