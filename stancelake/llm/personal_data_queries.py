"""Queries of problem 10: personal information inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread
from ..sources.tables import table
from .personal_data import find_spans, learn, sanitise


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents", "doc_id", "text"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_spans(_docs(spark, d), "doc_id", "text")


def p10_sanitised(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders."""
    return sanitise(_docs(spark, d), "doc_id", "text")


def p10_terms(spark: SparkSession, d: str) -> DataFrame:
    """How strongly each term discloses a person."""
    terms = learn(_docs(spark, d), "text")[1]
    return terms.select(F.col("w").alias("term"), F.col("n").alias("occurrences"), "near", F.round("bits", 4).alias("bits"), "successors", F.round("entropy", 4).alias("entropy"), "ends")


QUERIES = {f.__name__: f for f in (p10_found, p10_sanitised, p10_terms)}
SQL: dict[str, str] = {}
