"""Queries of problem 3: spellings of the same stakeholder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .name_variants import name_variants


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return name_variants(table(spark, d, "positions", "stakeholder"), "stakeholder")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d).select("name", "entity")
    a, b = e.withColumnRenamed("name", "name_a"), e.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling: its entity, named by the smallest spelling, and the number of its links."""
    e = _entities(spark, d)
    names = e.groupBy("entity").agg(F.min("name").alias("entity_name"), F.count("*").alias("n"))
    return e.join(names, "entity").select("name", "entity_name", F.col("weight").alias("occurrences"), (F.col("n") - 1).alias("links"))


QUERIES = {f.__name__: f for f in (p3_found, p3_entities)}
SQL: dict[str, str] = {}
