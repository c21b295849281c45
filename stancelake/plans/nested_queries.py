"""Queries of problem 1: nested extractor replies as related flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.semistructured import flatten_records, member_ordinals
from ..sources.tables import table


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_raw", "raw_id", "payload")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return member_ordinals(_raw(spark, d), "raw_id", "payload").toDF("raw_id", "pos_no", "target_no")


def p1_reports(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(_raw(spark, d), "raw_id", "payload")["root"]


def p1_positions(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(_raw(spark, d), "raw_id", "payload")["positions"]


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    return flatten_records(_raw(spark, d), "raw_id", "payload")["targets"]


QUERIES = {f.__name__: f for f in (p1_found, p1_reports, p1_positions, p1_targets)}
SQL: dict[str, str] = {}
