"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex that has an edge with the smallest vertex of its component.

    Returns ``(vertex, component)``.  Each round takes the smallest label among the
    neighbours (a partially aggregated ``min``) and then jumps to the label's own label,
    so chains halve; the loop ends when a round changes nothing.  Every round is written
    to the shared folder.  Self loops and null ends are ignored; repeated edges count once;
    an empty edge table gives an empty result.  Raises if ``max_rounds`` do not suffice.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "cc-labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        step = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        far = labels.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        new = materialize(step.join(far, "l").select("u", "old", F.least("l", "ll").alias("l")), "cc-labels")
        changed = new.where("l <> old").limit(1).count()
        release(labels)
        labels = new.select("u", "l")
        if not changed:
            return labels.select(F.col("u").alias("vertex"), F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
