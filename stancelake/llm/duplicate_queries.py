"""Queries of problem 2: articles that carry the same story."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .near_duplicates import duplicate_groups, expand_pairs, near_duplicates

RUN, SHARE = 3, 0.5


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "articles", "id", "title", "body").select("id", F.concat_ws(" ", "title", "body").alias("text"))
    return near_duplicates(docs, "id", "text", RUN, SHARE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return expand_pairs(*_links(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per article with its story's id."""
    g = duplicate_groups(*_links(spark, d))
    return g.select("id", "group_id", F.col("links").cast("bigint").alias("links")).distinct()


_SETS = r"""
WITH t AS (SELECT DISTINCT id, regexp_extract_all(lower(concat_ws(' ', title, body)), '[\p{L}\p{N}]+') AS w FROM articles WHERE id IS NOT NULL),
     s AS (SELECT DISTINCT id, w, array_to_string(w[i:i+2], ' ') AS g FROM t, unnest(range(1, len(w) - 1)) AS u(i)),
     n AS (SELECT id, w, count(*) AS n FROM s GROUP BY ALL),
     o AS (SELECT a.id AS ia, b.id AS ib, a.w AS wa, b.w AS wb, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
     p AS (SELECT DISTINCT ia AS id_a, ib AS id_b FROM o JOIN n na ON na.id = ia AND na.w = wa JOIN n nb ON nb.id = ib AND nb.w = wb WHERE 3 * o >= na.n + nb.n)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_groups)}
_GROUPS = r"""
WITH RECURSIVE t AS (SELECT DISTINCT id, regexp_extract_all(lower(concat_ws(' ', title, body)), '[\p{L}\p{N}]+') AS w FROM articles WHERE id IS NOT NULL),
     k AS (SELECT w, row_number() OVER (ORDER BY min(id), len(w), array_to_string(w, ' ')) AS k FROM t WHERE len(w) >= 3 GROUP BY w),
     m AS (SELECT id, k FROM t JOIN k USING (w)),
     s AS (SELECT DISTINCT k, array_to_string(w[i:i+2], ' ') AS g FROM k, unnest(range(1, len(w) - 1)) AS u(i)),
     n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
     o AS (SELECT a.k AS ka, b.k AS kb, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
     e AS (SELECT ka, kb FROM o JOIN n na ON na.k = ka JOIN n nb ON nb.k = kb WHERE 3 * o >= na.n + nb.n),
     b AS (SELECT ka AS u, kb AS v FROM e UNION ALL SELECT kb, ka FROM e),
     r AS (SELECT k AS u, k AS l FROM k UNION SELECT b.v, r.l FROM r JOIN b ON b.u = r.u),
     c AS (SELECT u AS k, min(l) AS c FROM r GROUP BY 1),
     f AS (SELECT c.c, min(m.id) AS group_id FROM m JOIN c USING (k) GROUP BY 1),
     d AS (SELECT u AS k, count(*) AS links FROM b GROUP BY 1)
SELECT DISTINCT m.id, f.group_id, coalesce(d.links, 0) AS links FROM m JOIN c USING (k) JOIN f USING (c) LEFT JOIN d USING (k)
"""
SQL = {"p2_found": _SETS + "SELECT id_a, id_b FROM p", "p2_groups": _GROUPS}
