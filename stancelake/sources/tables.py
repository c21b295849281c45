"""Readers for the project's tables; every reader returns a lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df
