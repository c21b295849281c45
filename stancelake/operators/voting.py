"""Votes of several models on the same candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

MODES = ("all", "majority", "any")


def single_model(matches: DataFrame, query: str, candidate: str, model_rank: int, threshold: float) -> DataFrame:
    """The best candidate ``(query, candidate, score)`` of one model alone, at least ``1 - threshold``."""
    own = matches.where((F.col("model_rank") == model_rank) & (F.col("rank") == 1))
    return own.where(F.col("score") >= F.lit(1.0) - F.lit(float(threshold))).select(query, candidate, "score")


def agreeing(matches: DataFrame, query: str, candidate: str, models: int, threshold: float) -> DataFrame:
    """The candidate that every model ranks first, each with at least ``1 - threshold``: ``(query, candidate, score)``, the highest score."""
    first = matches.where("rank = 1").groupBy(query, candidate).agg(F.count("*").alias("n"), F.min("score").alias("mn"), F.max("score").alias("score"))
    return first.where((F.col("n") == models) & (F.col("mn") >= F.lit(1.0) - F.lit(float(threshold)))).select(query, candidate, "score")


def votes(matches: DataFrame, query: str, candidate: str, top_k: int, model_rank: str = "model_rank") -> DataFrame:
    """``(query, candidate, n, mn, mx, first)`` of matches ``(query, candidate, model_rank, rank, score)``.

    ``first`` orders candidates as they were met: by model, then by rank.
    """
    return matches.groupBy(query, candidate).agg(
        F.count("*").alias("n"), F.min("score").alias("mn"), F.max("score").alias("mx"), F.min(F.col(model_rank) * top_k + F.col("rank")).alias("first"))


def elect(voted: DataFrame, query: str, candidate: str, models: int, threshold: float, mode: str) -> DataFrame:
    """The winning candidate of each query: the highest maximum score, first met among equals.

    ``all``: in every model's list and everywhere at least ``1 - threshold``; ``majority``: in more than
    half of the lists, at least that in each; ``any``: at least that somewhere.
    """
    if mode not in MODES:
        raise ValueError(f"unknown voting {mode!r}; one of {MODES}")
    least = F.lit(1.0) - F.lit(float(threshold))
    rule = {"all": (F.col("n") == models) & (F.col("mn") >= least), "majority": (F.col("n") > models // 2) & (F.col("mn") >= least), "any": F.col("mx") >= least}[mode]
    w = Window.partitionBy(query).orderBy(F.desc("mx"), "first", candidate)
    return voted.where(rule).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
