"""Queries of problem 9: evaluation items inside the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import spread
from ..sources.tables import table
from .leakage import leaks


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its field and extent."""
    return leaks(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "eval_items", "item_id", "passage", "question"), "doc_id", "text", "item_id", ["passage", "question"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that contain them."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


_PAIRS = r"""
WITH it AS (SELECT item_id, unnest([passage, question]) AS s FROM eval_items),
     iw AS (SELECT item_id, regexp_extract_all(lower(regexp_replace(s, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM it),
     ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM iw, unnest(range(1, len(w) - 6)) AS t(i)),
     dw AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
     dg AS (SELECT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM dw, unnest(range(1, len(w) - 6)) AS t(i)),
     hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

QUERIES = {f.__name__: f for f in (p9_found, p9_leaks, p9_items)}
_PLACES = r"""
WITH it AS (SELECT item_id, unnest(['passage', 'question']) AS field, unnest([passage, question]) AS s FROM eval_items),
     iw AS (SELECT item_id, field, regexp_extract_all(lower(regexp_replace(s, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM it),
     ig AS (SELECT item_id, field, array_to_string(w[i:i+7], ' ') AS g FROM iw, unnest(range(1, len(w) - 6)) AS t(i)),
     dw AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '</?[A-Za-z][^<>]*>', ' ', 'g')), '[\p{L}\p{N}]+') AS w FROM documents),
     dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i+7], ' ') AS g FROM dw, unnest(range(1, len(w) - 6)) AS t(i))
"""
SQL = {
    "p9_leaks": _PLACES + "SELECT doc_id, item_id, field, CAST(count(*) AS INTEGER) AS windows, CAST(min(pos) AS INTEGER) AS first_word FROM dg JOIN ig USING (g) GROUP BY 1, 2, 3",
    "p9_found": _PAIRS + "SELECT doc_id, item_id FROM hit",
    "p9_items": _PAIRS + "SELECT item_id, count(*) AS docs, min(doc_id) AS first_doc FROM hit GROUP BY item_id",
}
