"""Queries of problem 6: languages of article bodies and their paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread
from ..sources.tables import table
from .language import body_languages, classify, fit, paragraphs


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(spread(table(spark, d, "articles", "id", "body", "lang")), "id", "body", "lang")
    return classify(rows, fit(rows))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    seg = _segments(spark, d).where("label is null or label <> lang")
    return seg.select("id", "seg", "lang").distinct()


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every paragraph."""
    return _segments(spark, d).select("id", "seg", "lang", F.round("confidence", 4).alias("confidence")).distinct()


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Language and confidence of every body."""
    return body_languages(_segments(spark, d).drop("label").distinct()).withColumn("confidence", F.round("confidence", 4))


QUERIES = {f.__name__: f for f in (p6_found, p6_segments, p6_bodies)}
SQL: dict[str, str] = {}
