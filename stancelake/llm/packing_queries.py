"""Queries of problem 8: documents packed into context windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread
from ..sources.tables import table
from .packing import pack


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document's pieces, for each window."""
    return pack(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "pack_windows"), "doc_id", "text")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per window: containers, tokens, share of the space used, and texts cut."""
    p = p8_pack(spark, d)
    by = p.groupBy("window_id", "container_id").agg(F.sum("tokens").alias("tokens"), F.count_distinct(F.when(F.col("piece") > 0, F.col("doc_id"))).alias("cut"))
    w = table(spark, d, "pack_windows", "window_id", "capacity_tokens")
    cut = p.where("piece = 1").groupBy("window_id").agg(F.count("*").alias("texts_cut"))
    total = by.groupBy("window_id").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(F.broadcast(w), "window_id").join(cut, "window_id", "left")
    return total.select("window_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"), F.coalesce("texts_cut", F.lit(0)).alias("texts_cut"))


QUERIES = {f.__name__: f for f in (p8_pack, p8_fill)}
SQL: dict[str, str] = {}
