"""Queries of problem 4: the most similar vectors of every anchor row, per embedding model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .vector_neighbours import nearest

MODELS = {"jina": "jina_embeddings", "sentence_transformer": "sentence_transformer_embeddings"}


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """``model, id, vec`` of both models."""
    out = None
    for m, c in MODELS.items():
        v = table(spark, d, "df_max_views", "row_id", c).select(F.lit(m).alias("model"), F.col("row_id").alias("id"), F.col(c).alias("vec"))
        out = v if out is None else out.unionByName(v)
    return out


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(vectors(spark, d), k=5, min_similarity=0.85)
    return near.select("model", F.least("id", "other").alias("row_a"), F.greatest("id", "other").alias("row_b")).distinct()


def p4_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar rows of every row whose id is divisible by 50, among all rows."""
    near = nearest(vectors(spark, d), k=5, probes=160, cell_rows=4096, query_modulus=50)
    return near.select("model", F.col("id").alias("row_id"), F.col("other").alias("other_id"), F.col("rank").cast("int").alias("rank"), F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (p4_found, p4_top5)}
_PAIRS = """
WITH m AS (SELECT 'jina' AS model, row_id, CAST(jina_embeddings AS DOUBLE[]) AS v FROM df_max_views UNION ALL SELECT 'sentence_transformer', row_id, CAST(sentence_transformer_embeddings AS DOUBLE[]) FROM df_max_views),
     u AS (SELECT * FROM m WHERE v IS NOT NULL AND list_dot_product(v, v) > 0),
     s AS (SELECT a.model, a.row_id, b.row_id AS other_id, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.model = b.model AND a.row_id <> b.row_id AND len(a.v) = len(b.v) WHERE a.row_id % 50 = 0)
"""
SQL = {"p4_top5": _PAIRS + "SELECT model, row_id, other_id, CAST(row_number() OVER (PARTITION BY model, row_id ORDER BY s DESC, other_id) AS INTEGER) AS rank, round(s, 6) AS similarity FROM s QUALIFY rank <= 5"}
