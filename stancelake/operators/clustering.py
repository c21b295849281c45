"""Thresholded clusters, canonical replacement and label propagation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, release
from .graph import connected_components
from .vectors import block_pairs, dots, grid_blocks, grid_sides, near_rows, unit_rows, usable


def threshold_communities(items: DataFrame, pairs: DataFrame, weight: str | None = None, min_size: int = 1) -> DataFrame:
    """``(item, center, rank, canonical)`` from items ``i`` and pairs ``(i, j, s)`` of at least the threshold.

    An item's degree is the number of rows (``weight``) within the threshold, itself included.  With
    ``min_size`` 1 the greedy peeling of the largest communities has a closed form: an item belongs to
    its neighbour of largest degree, the smallest id among equals.  Members are ranked by similarity
    to the centre; the first one is canonical.  Items without pairs are their own cluster.  Larger
    ``min_size`` peels component by component and leaves the others out.
    """
    w = F.col(weight) if weight else F.lit(1)
    nodes = items.select("i", w.cast("long").alias("w"))
    edges = pairs.select("i", "j", "s").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "s")).unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("s")))
    if min_size > 1:
        return _peel(nodes, edges, min_size)
    deg = edges.join(nodes.select(F.col("i").alias("j"), "w"), "j").groupBy("i").agg(F.sum("w").alias("deg"))
    best = edges.join(deg, "i").groupBy("j").agg(F.min(F.struct((-F.col("deg")).alias("d"), F.col("i").alias("center"), "s")).alias("b"))
    member = best.select(F.col("j").alias("item"), F.col("b.center").alias("center"), F.col("b.s").alias("s"))
    return _ranked(member)


def vector_communities(rows: DataFrame, threshold: float) -> DataFrame:
    """``(item, center, canonical)`` of ``rows (i, w, v)``: communities of vectors of cosine at least ``1 - threshold``, without a table of their pairs.

    The closed form of ``threshold_communities`` on a grid of pairs of blocks.  Each pair of blocks gives its
    rows' degrees and keeps their partners as places in the block, a few bytes each; with all degrees known,
    it gives each row's best partner.  A centre that is a member of its own community is canonical: similarities end
    at one, and it has the smallest id among rows of its direction.  Where the centre belongs to a larger one, its
    members' similarities are computed.  Ids must be long integers; vectors without direction stand alone.
    """
    nodes = rows.select("i", F.col("w").cast("long").alias("w"))
    dims = [(r["d"], r["n"]) for r in usable(rows, "v").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()]  # a few models' lengths
    met = None
    for d, n in sorted(dims):
        part = usable(rows, "v").where(F.size("v") == d).select("i", F.col("w").cast("long").alias("w"), "v")
        part = block_pairs(part, grid_blocks(n, d)).groupBy("_a", "_b").applyInArrow(_degrees(1.0 - threshold), "_d int, _a int, _b int, i long, deg long, near array<int>")
        met = part if met is None else met.unionByName(part)
    if met is None:
        return nodes.select(F.col("i").alias("item"), F.col("i").alias("center"), F.col("i").alias("canonical"))
    met = materialize(met, "met-blocks")
    deg = nodes.select("i", F.col("w").alias("deg")).unionByName(met.select("i", "deg")).groupBy("i").agg(F.sum("deg").alias("deg"))
    deg = materialize(deg, "degrees")
    best = met.drop("deg").join(deg, "i").groupBy("_d", "_a", "_b").applyInArrow(_best_partner, "i long, deg long, center long")
    best = best.unionByName(deg.select("i", "deg", F.col("i").alias("center"))).groupBy("i").agg(F.min(F.struct((-F.col("deg")).alias("d"), "center")).alias("b"))
    best = materialize(best.select(F.col("i").alias("item"), F.col("b.center").alias("center")), "communities")
    release(met, deg)
    kept = best.where("item = center").select("center")
    lost = best.join(kept, "center", "left_anti")
    x, y = (rows.select(F.col("i").alias(k), F.col("v").alias(v)) for k, v in (("item", "_x"), ("center", "_y")))
    scored = lost.join(x, "item").join(y, "center").select("item", "center", "_x", "_y").mapInArrow(_scores, "item long, center long, s double")
    first = scored.groupBy("center").agg(F.min_by("item", F.struct(-F.col("s"), F.col("item"))).alias("first"))
    out = materialize(best.join(first, "center", "left").select("item", "center", F.coalesce("first", "center").alias("canonical")), "communities")
    release(best)
    return out


def _degrees(least: float):
    """A row's weight of partners in a pair of blocks, and the partners behind it as places among the rows of both by id."""

    def meet(table):
        import pyarrow as pa

        t, p, q, x, y = grid_sides(table)
        w = t["w"].to_numpy()
        deg = np.zeros(len(w))
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]
        for i, j in near_rows(x, y, least):
            i, j = p[i], q[j]
            deg += np.bincount(i, w[j], len(w)) + np.bincount(j, w[i], len(w))
            parts.append((i.astype(np.int32), j.astype(np.int32)))
        i, j = (np.concatenate(r) for r in zip(*parts))
        near = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(w)))]).astype(np.int32), j[np.argsort(i, kind="stable")])
        a, b = (np.full(len(w), t[k][0].as_py(), np.int32) for k in ("_a", "_b"))
        return pa.table({"_d": np.full(len(w), x.shape[1], np.int32), "_a": a, "_b": b, "i": t["i"], "deg": deg.astype(np.int64), "near": near})

    return meet


def _scores(batches):
    """Cosines of the vectors of pairs."""
    import pyarrow as pa

    for b in batches:
        lengths = b["_x"].value_lengths().to_numpy()
        for d in np.unique(lengths):
            part = b.filter(pa.array(lengths == d))
            x, y = unit_rows(part["_x"]), unit_rows(part["_y"])
            s = dots(x, y, np.arange(len(x)), np.arange(len(y)))
            yield pa.RecordBatch.from_arrays([part["item"], part["center"], pa.array(np.minimum(s, 1.0))], ["item", "center", "s"])


def _best_partner(table):
    """The partner of largest degree, the smallest id among equals, of each row of a pair of blocks that has one there."""
    import pyarrow as pa

    t = table.sort_by("i").combine_chunks()
    ids, deg, near = t["i"].to_numpy(), t["deg"].to_numpy(), t["near"].combine_chunks()
    order = np.lexsort((ids, -deg))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    i, j = np.repeat(np.arange(len(ids)), near.value_lengths().to_numpy()), near.flatten().to_numpy()
    best = np.full(len(ids), len(ids))
    np.minimum.at(best, i, rank[j])
    np.minimum.at(best, j, rank[i])
    has = np.flatnonzero(best < len(ids))
    at = order[best[has]]
    return pa.table({"i": ids[has], "deg": deg[at], "center": ids[at]})


def _ranked(member: DataFrame) -> DataFrame:
    # the canonical member needs an aggregate only; ranks are for description
    first = member.groupBy("center").agg(F.min_by("item", F.struct(-F.col("s"), F.col("item"))).alias("canonical"))
    w = Window.partitionBy("center").orderBy(F.desc("s"), "item")
    return member.withColumn("rank", F.row_number().over(w)).join(first, "center").select("item", "center", "rank", "canonical")


def _peel(nodes: DataFrame, edges: DataFrame, min_size: int) -> DataFrame:
    """Greedy peeling, exact within each connected component of the threshold graph."""
    comp = connected_components(edges.where("i <> j"), "i", "j").withColumnsRenamed({"vertex": "i", "component": "c"})
    e = edges.join(comp, "i").select("c", "i", "j", "s")
    kind = nodes.schema["i"].dataType.simpleString()

    def peel(pdf):
        import pandas as pd

        order = pdf.sort_values(["i", "s", "j"], ascending=[True, False, True])
        groups = [(i, g["j"].tolist(), g["s"].tolist()) for i, g in order.groupby("i", sort=True)]
        groups = [g for g in groups if len(g[1]) >= min_size]
        groups.sort(key=lambda g: (-len(g[1]), g[0]))
        taken: set = set()
        rows = []
        for i, js, ss in groups:
            left = [(j, s) for j, s in zip(js, ss) if j not in taken]
            if len(left) >= min_size:
                taken.update(j for j, _ in left)
                rows.extend((j, i, s) for j, s in left)
        return pd.DataFrame(rows, columns=["item", "center", "s"])

    return _ranked(e.groupBy("c").applyInPandas(peel, f"item {kind}, center {kind}, s double"))


def complete_linkage(items: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """``(item, center, rank, canonical)``: agglomerative complete linkage cut at distance ``threshold`` (strict).

    ``pairs`` holds all pairs nearer than the threshold as similarities; a missing pair cannot be
    merged, so each connected component is clustered on its own.  The canonical member is the
    smallest item.  Items without pairs stand alone.
    """
    close = pairs.where(1 - F.col("s") < threshold).select("i", "j", (1 - F.col("s")).alias("d"))
    comp = connected_components(close, "i", "j").withColumnsRenamed({"vertex": "i", "component": "c"})
    kind = items.schema["i"].dataType.simpleString()

    def merge(pdf):
        import pandas as pd

        names = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()]))
        at = {x: k for k, x in enumerate(names)}
        near = [dict() for _ in names]  # distances of clusters that may still merge
        for i, j, d in zip(pdf["i"], pdf["j"], pdf["d"]):
            near[at[i]][at[j]] = near[at[j]][at[i]] = d
        group = {k: [k] for k in range(len(names))}
        import heapq

        heap = [(d, min(a, b), max(a, b)) for a in range(len(names)) for b, d in near[a].items() if a < b]
        heapq.heapify(heap)
        alive = set(group)
        while heap:
            d, a, b = heapq.heappop(heap)
            if a not in alive or b not in alive or near[a].get(b) != d:
                continue
            both = near[a].keys() & near[b].keys() - {a, b}
            new = {c: max(near[a][c], near[b][c]) for c in both}
            for c in near[b]:
                near[c].pop(b, None)
            for c in set(near[a]) - both:
                near[c].pop(a, None)
            group[a] += group.pop(b)
            alive.discard(b)
            near[a] = new
            for c, x in new.items():
                near[c][a] = x
                heapq.heappush(heap, (x, min(a, c), max(a, c)))
        rows = [(names[m], names[min(g)]) for g in group.values() for m in g]
        return pd.DataFrame(rows, columns=["item", "center"])

    grown = close.join(comp, "i").groupBy("c").applyInPandas(merge, f"item {kind}, center {kind}")
    alone = items.select(F.col("i").alias("item")).join(comp.select(F.col("i").alias("item")), "item", "left_anti").withColumn("center", F.col("item"))
    member = materialize(grown.unionByName(alone), "linkage")
    w = Window.partitionBy("center").orderBy("item")
    return member.withColumn("rank", F.row_number().over(w)).withColumn("canonical", F.col("center")).select("item", "center", "rank", "canonical")


METHODS = ("fast", "agglomerative")


def cluster(items: DataFrame, pairs: DataFrame, threshold: float, method: str = "fast", weight: str | None = None, min_size: int = 1) -> DataFrame:
    """Clusters at a distance threshold by the named method."""
    if method == "fast":
        return threshold_communities(items, pairs.where(F.col("s") >= F.lit(1.0) - F.lit(float(threshold))), weight, min_size)
    if method == "agglomerative":
        return complete_linkage(items, pairs, threshold)
    raise ValueError(f"unknown clustering method {method!r}; one of {METHODS}")


def replace_by_canonical(df: DataFrame, col: str, mapping: DataFrame, item: str = "item", canonical: str = "canonical") -> DataFrame:
    """``col`` replaced by its canonical value where the mapping has one; Spark broadcasts a small mapping by itself."""
    m = mapping.select(F.col(item).alias(col), F.col(canonical).alias("_canon"))
    return df.join(m, col, "left").withColumn(col, F.coalesce("_canon", col)).select(*df.columns)


def propagate(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(item, label, source)``: members without a label take that of the first labelled member of their cluster.

    Members with another label keep it; clusters without any label stay unlabelled.
    """
    m = members.join(labels, "item", "left")
    first = m.where("label is not null").groupBy("center").agg(F.min_by("label", "rank").alias("_label"))
    out = m.join(first, "center", "left")
    return out.select("item", F.coalesce("label", "_label").alias("label"), F.when(F.col("label").isNotNull(), "own").when(F.col("_label").isNotNull(), "cluster").alias("source"))


def conflicting(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(center, labels)``: clusters whose members carry more than one label."""
    return members.join(labels, "item").groupBy("center").agg(F.sort_array(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
