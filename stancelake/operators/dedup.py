"""Deterministic survivors: first, best and top rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; the order must tell all rows apart. Null keys are one key.

    A partial aggregate per key (no sort, no window), so a hot key is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order]))
    return df.groupBy(*keys).agg(first.alias("_r")).select(*[F.col(f"`{c}`") if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def best_per_key(df: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The row with the largest ``by`` of each key, the smallest ``tie`` among equals; null ``by`` comes last."""
    return keep_first(df, keys, [F.col(by).isNull(), -F.coalesce(F.col(by), F.lit(0)), F.col(tie)])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def most_common(df: DataFrame, keys: list[str], item: str, seen: str, k: int) -> DataFrame:
    """``(keys, item, n, rank)``: the k most frequent items of each key, first seen first among equals."""
    counts = df.where(F.col(item).isNotNull()).groupBy(*keys, item).agg(F.count("*").alias("n"), F.min(seen).alias("_first"))
    return top_per_key(counts, keys, [F.desc("n"), F.col("_first")], k).drop("_first")


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """A repeatable uniform sample of n rows: the smallest salted digests of the id."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))).orderBy("_h", id_col).limit(n).drop("_h")
