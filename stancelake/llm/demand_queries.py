"""Queries of problem 5: positions that state the same demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread
from ..sources.tables import table
from .demand_clusters import clusters, describe


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "positions", "position_id", "position"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters(_rows(spark, d), "position_id", "position")[0].selectExpr("id AS position_id", "cluster_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every cluster with its size and most typical wordings."""
    rows = _rows(spark, d)
    return describe(*clusters(rows, "position_id", "position"), rows, "position_id", "position")


QUERIES = {f.__name__: f for f in (p5_found, p5_clusters)}
SQL: dict[str, str] = {}
