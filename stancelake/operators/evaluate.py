"""Pairwise evaluation of clusterings, and parameter grids."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def positive_pairs(clusters: DataFrame, cluster: str, name: str) -> DataFrame:
    """Distinct unordered pairs of names that share a cluster."""
    x = clusters.select(F.col(cluster).alias("k"), F.col(name).alias("x")).distinct()
    y = x.withColumnRenamed("x", "y")
    return x.join(y, "k").where("x < y").select(*_pair("x", "y")).distinct()


def negative_pairs(clusters: DataFrame, cluster: str, name: str) -> DataFrame:
    """Distinct unordered pairs of names of different clusters.

    Meant for a gold set of fixed size: it is quadratic in the set, which is counted before it is
    broadcast; more than 20,000 rows are refused.
    """
    x = clusters.select(F.col(cluster).alias("k"), F.col(name).alias("x")).distinct()
    if x.count() > 20_000:
        raise ValueError("negative pairs are defined for gold sets of at most 20,000 names")
    y = x.select(F.col("k").alias("l"), F.col("x").alias("y"))
    return x.join(F.broadcast(y), F.col("k") < F.col("l")).where("x <> y").select(*_pair("x", "y")).distinct()


def confusion(gold_pos: DataFrame, gold_neg: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row of counts: tp, fn, fp, tn of unordered pairs ``(a, b)``."""
    p = predicted.select(*_pair("a", "b")).distinct().withColumn("hit", F.lit(1))
    pos = gold_pos.select("a", "b", F.lit(1).alias("gold"))
    neg = gold_neg.select("a", "b", F.lit(0).alias("gold"))
    rows = pos.unionByName(neg).join(p, ["a", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    n = lambda g, h: F.count(F.when((F.col("gold") == g) & (F.col("hit") == h), 1))
    return rows.agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 1).alias("fp"), n(0, 0).alias("tn"))


def negative_count(clusters: DataFrame, cluster: str, name: str) -> DataFrame:
    """One row ``n``: how many pairs ``negative_pairs`` has, without making them.

    Of all pairs of names those are no negatives whose names are in one and the same single cluster.
    """
    own = clusters.select(F.col(cluster).alias("k"), F.col(name).alias("x")).distinct().groupBy("x").agg(F.count("*").alias("c"), F.min("k").alias("k"))
    pairs = lambda n: n * (n - 1) / 2
    alone = own.groupBy("k").agg(F.count("*").alias("names"), F.count(F.when(F.col("c") == 1, 1)).alias("single"))
    return alone.agg((pairs(F.sum("names")) - F.sum(pairs(F.col("single")))).cast("bigint").alias("n"))


def confusion_closed(clusters: DataFrame, cluster: str, name: str, predicted: DataFrame) -> DataFrame:
    """The counts of ``confusion`` of predicted pairs ``(a, b)`` against clusters of any size: only predicted and positive pairs are made."""
    gold = positive_pairs(clusters, cluster, name)
    own = clusters.select(F.col(cluster).alias("k"), F.col(name).alias("x")).distinct().groupBy("x").agg(F.count("*").alias("c"), F.min("k").alias("k"))
    p = predicted.where("a <> b").select(*_pair("a", "b")).distinct()
    both = p.join(own.toDF("a", "ca", "ka"), "a").join(own.toDF("b", "cb", "kb"), "b")
    # a pair is negative unless both names have one cluster, and the same one
    fp = both.where("not (ca = 1 and cb = 1 and ka = kb)").agg(F.count("*").alias("fp"))
    hits = gold.join(p.withColumn("hit", F.lit(1)), ["a", "b"], "left").agg(F.count("hit").alias("tp"), (F.count("*") - F.count("hit")).alias("fn"))
    one = hits.crossJoin(fp).crossJoin(negative_count(clusters, cluster, name))  # three single rows
    return one.select("tp", "fn", "fp", (F.col("n") - F.col("fp")).alias("tn"))


def label_sweep(edges: DataFrame, labels: DataFrame, item: str, label: str, thresholds: list[float]) -> DataFrame:
    """Metrics of the edges ``(a, b, s)`` at each distance threshold against labels of the items; pairs without an edge are only counted.

    Every unordered pair of labelled items is positive if the labels agree, else negative; their numbers
    follow from the sizes of the labels.
    """
    own = labels.select(F.col(item).alias("x"), F.col(label).alias("k")).where("k is not null")
    pairs = lambda n: n * (n - 1) / 2
    total = own.groupBy("k").agg(F.count("*").alias("n")).agg(F.sum(pairs(F.col("n"))).cast("bigint").alias("pos"), pairs(F.sum("n")).cast("bigint").alias("all"))
    t = edges.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    met = edges.join(own.toDF("a", "ka"), "a").join(own.toDF("b", "kb"), "b").select((F.col("ka") == F.col("kb")).alias("same"), "s")
    hits = [F.count(F.when(F.col("s") >= F.lit(1.0) - F.lit(float(x)), 1)).alias(f"h{i}") for i, x in enumerate(thresholds)]
    got = met.groupBy("same").agg(*hits)
    rows = got.select("same", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"h{i}").alias("h")) for i, x in enumerate(thresholds)])).alias("y")).select("same", "y.*")
    by = t.join(rows, "threshold", "left").groupBy("threshold").agg(F.coalesce(F.sum(F.when(F.col("same"), F.col("h"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(~F.col("same"), F.col("h"))), F.lit(0)).alias("fp"))
    full = by.crossJoin(F.broadcast(total))  # a few settings with one row of totals
    return metrics(full.select("threshold", "tp", (F.col("pos") - F.col("tp")).alias("fn"), "fp", (F.col("all") - F.col("pos") - F.col("fp")).alias("tn")))


def link_grid(pairs: DataFrame, models: list[str], gold: str, thresholds: list[float], least: int = 3) -> DataFrame:
    """Metrics of every setting of threshold x model subset x voting over labelled pairs.

    ``pairs`` has one similarity column a model and the truth ``gold``.  ``all``: every model of the subset
    reaches ``1 - threshold``; ``majority``: more than half do; ``any``: one does.  Each pair shrinks to the
    number of thresholds that each model passes; the settings meet those few patterns, never the pairs.
    """
    order = sorted(float(x) for x in thresholds)
    level = [sum((F.when(F.col(m) >= F.lit(1.0) - F.lit(x), 1).otherwise(0) for x in order), F.lit(0)) for m in models]
    pattern = pairs.where(F.col(gold).isNotNull()).groupBy(F.array(*level).alias("passed"), F.col(gold).alias("g")).agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    rows = [(x, len(order) - i, s, v) for i, x in enumerate(order) for s in model_subsets(models, least) for v in ("all", "majority", "any")]
    grid_ = spark.createDataFrame(rows, "threshold double, need int, models array<string>, voting string")
    at = F.create_map(*[F.lit(x) for i, m in enumerate(models) for x in (m, i)])
    # a wide threshold is passed by whoever passes a narrow one: model m reaches the i-th of K thresholds if it passes at least K - i
    agree = F.size(F.filter("models", lambda m: F.element_at("passed", at[m] + 1) >= F.col("need")))
    hit = F.when(F.col("voting") == "all", agree == F.size("models")).when(F.col("voting") == "majority", agree * 2 > F.size("models")).otherwise(agree > 0)
    met = pattern.crossJoin(F.broadcast(grid_)).withColumn("hit", hit)  # patterns and settings, both few
    n = lambda g, h: F.coalesce(F.sum(F.when((F.col("g") == g) & (F.col("hit") == h), F.col("n"))), F.lit(0))
    counts = met.groupBy("threshold", "models", "voting").agg(n(True, True).alias("tp"), n(True, False).alias("fn"), n(False, True).alias("fp"), n(False, False).alias("tn"))
    return metrics(counts)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def metrics(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Precision, recall, F1, accuracy, false positive rate and specificity; 0 where a denominator is 0."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    cols = {"precision": p, "recall": r, "f1_score": F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), "accuracy": ratio(tp + tn, tp + fn + fp + tn), "fpr": ratio(fp, fp + tn), "specificity": ratio(tn, tn + fp)}
    return counts.select("*", *[F.round(v, digits).alias(k) for k, v in cols.items()])


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """The Cartesian product of parameter values, the last parameter fastest; a driver-side table of settings."""
    return spark.createDataFrame(list(itertools.product(*values.values())), list(values))


def model_subsets(models: list[str], least: int) -> list[list[str]]:
    """All subsets of at least that many models, smaller ones first."""
    return [list(c) for r in range(least, len(models) + 1) for c in itertools.combinations(models, r)]


def threshold_sweep(edges: DataFrame, gold_pos: DataFrame, gold_neg: DataFrame, thresholds: list[float]) -> DataFrame:
    """Metrics of the pairs linked at each distance threshold; the edges ``(a, b, s)`` are scanned once for all of them."""
    spark = edges.sparkSession
    t = spark.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    p = edges.select(*_pair("a", "b"), "s")
    gold = gold_pos.select("a", "b", F.lit(1).alias("gold")).unionByName(gold_neg.select("a", "b", F.lit(0).alias("gold")))
    rows = gold.join(p, ["a", "b"], "left").crossJoin(F.broadcast(t))  # a few settings, not rows
    hit = F.coalesce(F.col("s") >= 1 - F.col("threshold"), F.lit(False))
    n = lambda g, h: F.count(F.when((F.col("gold") == g) & (hit == h), 1))
    counts = rows.groupBy("threshold").agg(n(1, True).alias("tp"), n(1, False).alias("fn"), n(0, True).alias("fp"), n(0, False).alias("tn"))
    return metrics(counts)
