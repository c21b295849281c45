"""Topics: reduction, density clusters, class-based TF-IDF, outliers, hierarchy, grids."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import materialize
from .vectors import euclidean_score, knn, mean_pool, normalize

#: Topics of a hierarchy: its tree is built on the driver from one number for every two topics, so more are refused.
MAX_TOPICS = 5_000
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(df: DataFrame, text: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.explode(F.split(F.lower(text), TOKEN_SPLIT)).alias("term")).where("term <> ''")


def class_tfidf(docs: DataFrame, topic: str, text: str) -> DataFrame:
    """``(topic, term, tf, ctfidf)``: tf * log(1 + A / f) with A the mean number of tokens a topic, f the term's total.

    Null topics and texts are left out.
    """
    tf = tokens(docs.where(F.col(topic).isNotNull()), text, F.col(topic).alias("topic")).groupBy("topic", "term").agg(F.count("*").alias("tf"))
    tf = materialize(tf, "ctfidf")
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    a = tf.agg((F.sum("tf") / F.count_distinct("topic")).alias("a"))
    return tf.join(f, "term").crossJoin(F.broadcast(a)).select("topic", "term", "tf", (F.col("tf") * F.log(1 + F.col("a") / F.col("f"))).alias("ctfidf"))  # one row of totals


def top_terms(weights: DataFrame, k: int = 10) -> DataFrame:
    """``(topic, term, ctfidf, rank)`` of the k heaviest terms a topic."""
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("ctfidf", 9)), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def reduce_dims(df: DataFrame, id_col: str, vec: str, dims: int = 5, seed: int = 42) -> DataFrame:
    """``(id, vec)`` projected on the leading directions of the data (PCA, centred), in one pass over the data.

    The covariance is summed per partition, so only dims x dims numbers reach the driver.
    """
    rows = df.where(F.col(vec).isNotNull()).select(id_col, normalize(vec).alias("v")).where("v is not null")

    def moments(batches: Iterable) -> Iterator:
        import pandas as pd

        n, s, c = 0, None, None
        for pdf in batches:
            x = np.stack(pdf["v"].map(np.asarray)) if len(pdf) else None
            if x is None:
                continue
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            c = x.T @ x if c is None else c + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "c": [c.ravel().tolist()]})

    parts = rows.select("v").mapInPandas(moments, "n long, s array<double>, c array<double>")
    size = F.sum("n").alias("n")
    got = parts.select("n", F.posexplode("s").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x"), size).toPandas()  # one row a dimension
    if not len(got):
        return rows.select(id_col, F.col("v").alias(vec))
    d, n = len(got), int(got["n"].iloc[0])
    mean = got.sort_values("p")["x"].to_numpy() / n
    c = parts.select(F.posexplode("c").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).orderBy("p").toPandas()["x"].to_numpy().reshape(d, d) / n - np.outer(mean, mean)
    val, base = np.linalg.eigh(c)
    base = base[:, ::-1][:, :dims]
    base *= np.sign(base[np.abs(base).argmax(axis=0), np.arange(base.shape[1])])
    held = df.sparkSession.sparkContext.broadcast((mean, base))

    def project(batches: Iterable) -> Iterator:
        m, b = held.value
        for pdf in batches:
            if len(pdf):
                x = (np.stack(pdf["v"].map(np.asarray)) - m) @ b
                yield pdf[[id_col]].assign(**{vec: list(x)})

    return rows.mapInPandas(project, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{vec}` array<double>")


def density_clusters(points: DataFrame, id_col: str, vec: str, min_cluster_size: int = 10, min_samples: int = 5, edges_per_point: int = 15) -> DataFrame:
    """``(id, topic)``: clusters of density, -1 for outliers, topics numbered by size from 0.

    Mutual reachability over the graph of nearest neighbours (distance at least both points'
    ``min_samples``-th neighbour), single linkage over its edges, and the excess-of-mass choice over
    the condensed tree.  The tree is built on the driver up to 200,000 points; more are refused.
    """
    n = points.count()
    if n > 200_000:
        raise ValueError("density clusters are defined for at most 200,000 points")
    if n <= max(min_cluster_size, 1):
        return points.select(F.col(id_col).alias("id"), F.lit(-1).alias("topic"))
    k = max(min_samples, min(edges_per_point, n - 1))
    near = materialize(_euclid_knn(points, id_col, vec, k), "density-near")
    core = near.where(F.col("rank") == min(min_samples, n - 1)).select(F.col("i").alias("x"), F.col("d").alias("core"))
    e = near.join(core.withColumnRenamed("x", "i").withColumnRenamed("core", "ci"), "i").join(core.withColumnRenamed("x", "j").withColumnRenamed("core", "cj"), "j")
    e = e.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.greatest("d", "ci", "cj").alias("w")).groupBy("a", "b").agg(F.min("w").alias("w"))
    edges = e.orderBy("w", "a", "b").toPandas()  # at most points x edges_per_point rows, bounded above
    ids = np.sort(points.select(id_col).toPandas()[id_col].to_numpy())
    topic = condensed(ids, edges[["a", "b", "w"]].to_numpy(), min_cluster_size)
    kind = points.schema[id_col].dataType.simpleString()
    return points.sparkSession.createDataFrame([(i.item() if hasattr(i, "item") else i, int(t)) for i, t in zip(ids, topic)], f"id {kind}, topic int")


def _euclid_knn(points: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """``(i, j, d, rank)``: the k nearest other points by Euclidean distance, exactly; the origin is a point like any other."""
    # one more coordinate keeps the origin from being a vector without direction and changes no distance
    p = points.select(F.col(id_col).alias("i"), F.concat(vec, F.array(F.lit(1.0))).alias("v"))
    near = knn(p, p.withColumnRenamed("i", "j"), k, "i", "j", "v", exclude_self=True, score=euclidean_score)
    return near.select("i", "j", (-F.col("score")).alias("d"), "rank")


def condensed(ids: np.ndarray, edges: np.ndarray, min_size: int) -> np.ndarray:
    """Labels from sorted edges ``(a, b, w)``: single linkage, condensed tree, excess of mass; -1 for outliers."""
    at = {x: k for k, x in enumerate(ids)}
    n = len(ids)
    parent = list(range(2 * n))
    size = [1] * n + [0] * n
    kids: dict[int, tuple[int, int, float]] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    new = n
    for a, b, w in edges:
        x, y = root(at[a]), root(at[b])
        if x != y:
            parent[x] = parent[y] = new
            size[new] = size[x] + size[y]
            kids[new] = (x, y, float(w))
            new += 1
    tops = sorted({root(i) for i in range(n)})
    # condensed clusters: (birth, parent); every point leaves a cluster at some density 1 / w
    birth: dict[int, float] = {}
    up: dict[int, int | None] = {}
    mass: dict[int, float] = {}
    points: dict[int, list[int]] = {}
    count = 0
    todo: list[tuple[int, int]] = []
    for t in tops:
        if size[t] >= min_size:
            birth[count], up[count], mass[count], points[count] = 0.0, None, 0.0, []
            todo.append((t, count))
            count += 1

    def leaves(x: int) -> list[int]:
        out, st = [], [x]
        while st:
            y = st.pop()
            if y < n:
                out.append(y)
            else:
                st.extend(kids[y][:2])
        return out

    while todo:
        x, c = todo.pop()
        while True:
            if x < n:
                points[c].append(x)
                break
            a, b, w = kids[x]
            lam = 1.0 / max(w, 1e-12)
            big = [y for y in (a, b) if size[y] >= min_size]
            if len(big) == 2:
                mass[c] += (lam - birth[c]) * size[x]
                for y in big:
                    birth[count], up[count], mass[count], points[count] = lam, c, 0.0, []
                    todo.append((y, count))
                    count += 1
                break
            for y in (a, b):
                if size[y] < min_size:
                    gone = leaves(y)
                    points[c].extend(gone)
                    mass[c] += (lam - birth[c]) * len(gone)
            if not big:
                break
            x = big[0]
    children: dict[int, list[int]] = {c: [] for c in range(count)}
    for c, p in up.items():
        if p is not None:
            children[p].append(c)
    best, chosen = {}, {}
    for c in reversed(range(count)):
        inner = sum(best[k] for k in children[c])
        root_split = up[c] is None and bool(children[c])
        chosen[c] = not root_split and mass[c] >= inner
        best[c] = mass[c] if chosen[c] else inner
    label = np.full(n, -1)
    groups = []
    st = [c for c in range(count) if up[c] is None]
    while st:
        c = st.pop()
        if chosen[c]:
            got, inner = [], [c]
            while inner:
                k = inner.pop()
                got.extend(points[k])
                inner.extend(children[k])
            groups.append(got)
        else:
            st.extend(children[c])
    for t, g in enumerate(sorted(groups, key=lambda g: (-len(g), min(g)))):
        label[g] = t
    return label


def centroids(docs: DataFrame, topic: str, vec: str) -> DataFrame:
    """``(topic, centroid)``: mean vector of each topic; the outlier topic -1 has none."""
    return mean_pool(docs.where(F.col(topic) >= 0).select(F.col(topic).alias("topic"), vec), ["topic"], vec, "centroid")


def reduce_outliers(docs: DataFrame, id_col: str, topic: str, vec: str) -> DataFrame:
    """``(id, topic)`` with every outlier (-1) given the topic of the nearest centroid; without topics nothing changes."""
    c = centroids(docs, topic, vec).withColumnRenamed("centroid", vec)
    out = docs.where(F.col(topic) == -1).select(id_col, vec)
    near = knn(out, materialize(c, "centroids"), 1, id_col, "topic", vec).select(F.col(id_col), F.col("topic").alias("_t"))
    return docs.select(id_col, topic).join(near, id_col, "left").select(id_col, F.coalesce("_t", topic).alias(topic))


def representative_docs(docs: DataFrame, id_col: str, topic: str, vec: str, k: int = 3) -> DataFrame:
    """``(topic, id, score, rank)``: the k documents most similar to their topic's centroid."""
    d = docs.where((F.col(topic) >= 0) & F.col(vec).isNotNull()).select(F.col(topic).alias("topic"), id_col, normalize(vec).alias("v"))
    c = centroids(docs, topic, vec).select("topic", normalize("centroid").alias("c"))
    s = d.join(c, "topic").select("topic", id_col, F.aggregate(F.zip_with("v", "c", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("score", 9)), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def outlier_stats(docs: DataFrame, topic: str) -> DataFrame:
    out = F.count(F.when(F.col(topic) == -1, 1))
    return docs.agg(out.alias("outlier_count"), F.when(F.count("*") == 0, 0.0).otherwise(F.round(100.0 * out / F.count("*"), 2)).alias("outlier_percentage"))


def rerank_terms(weights: DataFrame, encoder: Callable[[list[str]], np.ndarray], k: int = 10, pool: int = 30, diversity: float = 0.3) -> DataFrame:
    """``(topic, term, rank)`` by maximal marginal relevance: near the topic's own terms, far from the chosen ones.

    ``diversity`` 0 ranks by nearness to the topic alone.  One task a topic, which holds ``pool`` terms.
    """
    top = top_terms(weights, pool)
    kind = weights.schema["topic"].dataType.simpleString()

    def choose(pdf):
        import pandas as pd

        pdf = pdf.sort_values("rank")
        x = np.asarray(encoder(pdf["term"].tolist()), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        topic = (x * pdf["ctfidf"].to_numpy()[:, None]).sum(0)
        rel = x @ (topic / max(np.linalg.norm(topic), 1e-12))
        took: list[int] = []
        while len(took) < min(k, len(x)):
            red = (x @ x[took].T).max(axis=1) if took else np.zeros(len(x))
            score = (1 - diversity) * rel - diversity * red
            score[took] = -np.inf
            took.append(int(score.argmax()))
        return pd.DataFrame({"topic": pdf["topic"].iloc[0], "term": pdf["term"].to_numpy()[took], "rank": range(1, len(took) + 1)})

    return top.groupBy("topic").applyInPandas(choose, f"topic {kind}, term string, rank int")


def topic_hierarchy(weights: DataFrame, members: DataFrame, topic: str, id_col: str) -> DataFrame:
    """``(Parent_ID, Topics, left, right, distance, sentence_count)``: average linkage of the topics.

    Distance is 1 - clip(cosine) of their c-TF-IDF vectors.  The tree is as large as the number of
    topics, which is bounded by MAX_TOPICS; members are counted per topic before they meet it
    (``hierarchy_members`` lists them, one row each).
    """
    spark = weights.sparkSession
    ids = [r["topic"] for r in weights.select("topic").distinct().orderBy("topic").limit(MAX_TOPICS + 1).collect()]
    if len(ids) > MAX_TOPICS:
        raise ValueError(f"hierarchies are defined for at most {MAX_TOPICS} topics")
    norm = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("ctfidf") * F.col("ctfidf"))).alias("norm"))
    w = weights.join(norm, "topic").select("topic", "term", (F.col("ctfidf") / F.col("norm")).alias("x"))
    dots = w.join(w.select(F.col("topic").alias("other"), "term", F.col("x").alias("y")), "term").where("topic < other").groupBy("topic", "other").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    n = len(ids)
    at = {t: i for i, t in enumerate(ids)}
    dist = np.ones((n, n))
    for r in dots.toLocalIterator():  # at most MAX_TOPICS^2 / 2 numbers
        dist[at[r["topic"]], at[r["other"]]] = dist[at[r["other"]], at[r["topic"]]] = 1 - min(1.0, max(-1.0, r["s"]))
    rows = average_linkage(ids, dist)
    tree = spark.createDataFrame(rows, "Parent_ID int, left int, right int, distance double, Topics array<int>") if rows else spark.createDataFrame([], "Parent_ID int, left int, right int, distance double, Topics array<int>")
    size = members.where(F.col(topic).isNotNull()).groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("n"))
    sent = tree.select("Parent_ID", F.explode("Topics").alias("topic")).join(size, "topic").groupBy("Parent_ID").agg(F.sum("n").alias("sentence_count"))
    return tree.join(sent, "Parent_ID", "left")


def hierarchy_members(tree: DataFrame, members: DataFrame, topic: str, id_col: str) -> DataFrame:
    """``(Parent_ID, id)``: the sentences below every node of the tree, one row each."""
    return tree.select("Parent_ID", F.explode("Topics").alias("topic")).join(members.select(F.col(topic).alias("topic"), id_col), "topic").select("Parent_ID", id_col)


def average_linkage(ids: list[int], dist: np.ndarray) -> list[tuple]:
    """Merges of average linkage as (parent, left, right, distance, leaves); parents are numbered after the topics."""
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label = {i: t for i, t in enumerate(ids)}
    leaves = {i: [t] for i, t in enumerate(ids)}
    size = np.ones(len(ids))
    rows, parent, live = [], (max(ids) + 1) if ids else 0, len(ids)
    while live > 1:
        a, b = np.unravel_index(np.argmin(d), d.shape)
        a, b = (int(a), int(b)) if a < b else (int(b), int(a))
        height = float(d[a, b])
        merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        leaves[a] = sorted(leaves[a] + leaves[b])
        rows.append((parent, label[a], label[b], height, leaves[a]))
        label[a] = parent
        parent += 1
        live -= 1
    return rows


def topic_grid(spark: SparkSession, points: DataFrame, id_col: str, vec: str, settings: list[dict], done: DataFrame | None = None) -> DataFrame:
    """One row of outlier statistics and topic counts per setting; a failing setting gives a row of -1, finished ones are skipped."""
    keys = ["n_neighbors", "n_components", "min_cluster_size", "min_samples"]
    settings = [{"n_neighbors": 15, **s} for s in settings]
    seen = {tuple(r[k] for k in keys) for r in done.select(*keys).distinct().collect()} if done is not None else set()  # a few settings
    rows = []
    for s in settings:
        if tuple(s[k] for k in keys) in seen:
            continue
        try:
            low = materialize(reduce_dims(points, id_col, vec, s["n_components"]), "grid")
            t = density_clusters(low, id_col, vec, s["min_cluster_size"], s["min_samples"], s["n_neighbors"])
            st = outlier_stats(t, "topic").first()
            rows.append((*[s[k] for k in keys], st["outlier_count"], float(st["outlier_percentage"]), t.where("topic >= 0").select("topic").distinct().count()))
        except Exception:
            rows.append((*[s[k] for k in keys], -1, -1.0, -1))
    new = spark.createDataFrame(rows, "n_neighbors int, n_components int, min_cluster_size int, min_samples int, outlier_count long, outlier_percentage double, original_topic_count long")
    return new if done is None else done.unionByName(new)
