"""Queries of problem 7: stakeholders and anchor texts mapped to the reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .reference_mapping import map_values, reference_rows

_CLEAN = r"(?U)^\s+|\s+$"


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows to map, ``(src, row_key, value)``, and the reference list."""
    kb = table(spark, d, "kb_items")
    named = reference_rows(kb).select(F.explode("names").alias("value")).distinct()
    s = table(spark, d, "positions", "position_id", "stakeholder").select(F.lit("stakeholder").alias("src"), F.col("position_id").alias("row_key"), F.regexp_replace(F.lower("stakeholder"), _CLEAN, "").alias("value"))
    s = s.where("value is not null and value <> ''").join(named, "value", "left_anti").select("src", "row_key", "value")
    a = table(spark, d, "df_max_views", "row_id", "normalized_anchor_text", "target_item_id").where("normalized_anchor_text is not null and normalized_anchor_text <> ''")
    a = a.join(kb.select(F.col("item_id").alias("target_item_id")), "target_item_id", "left_anti")
    a = a.select(F.lit("anchor").alias("src"), F.col("row_id").alias("row_key"), F.regexp_replace(F.lower("normalized_anchor_text"), _CLEAN, "").alias("value"))
    return s.unionByName(a), kb


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows, kb = _cases(spark, d)
    found = map_values(rows, kb, "value")
    return rows.join(found, "value", "left").select("src", "row_key", F.coalesce("item_id", F.lit(-1)).alias("item_id"))


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct value with the entry it means and the score; unmatched ones carry -1."""
    rows, kb = _cases(spark, d)
    return map_values(rows, kb, "value")


QUERIES = {f.__name__: f for f in (p7_found, p7_values)}
SQL: dict[str, str] = {}
