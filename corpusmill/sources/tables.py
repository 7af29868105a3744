"""Readers for the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.session import ship


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """``root/name.parquet`` with only ``columns`` (all, if none are named); unknown extra columns are never touched."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df
