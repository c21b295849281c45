"""The whole way from nested reports to cleaned positions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize_text, order_key
from ..operators.clustering import replace_by_canonical
from ..operators.dedup import best_per_key, keep_first
from ..operators.linking import LinkConfig, cluster_texts, link_entities
from ..operators.nested import explode_positions, explode_targets, regroup, with_members
from ..operators.vectors import hashed_embedding
from ..session import materialize, release


@dataclass
class PostProcessConfig:
    """Distance thresholds of each step."""

    positions: float = 0.2
    stakeholders: float = 0.3
    targets: float = 0.15
    predicates: float = 0.05
    voting: str = "all"
    method: str = "fast"
    encoder: object = field(default_factory=lambda: hashed_embedding(96, 3, 1))


def anchor_table(anchors: DataFrame) -> DataFrame:
    """One row per anchor text, the one with most page views; empty and null texts are left out."""
    return best_per_key(anchors.where("normalized_anchor_text is not null and normalized_anchor_text <> ''"), ["normalized_anchor_text"], "target_page_views", "row_id")


def post_process(reports: DataFrame, anchors: DataFrame, kb: DataFrame, cfg: PostProcessConfig | None = None) -> dict[str, DataFrame]:
    """Cleaned positions with canonical stakeholders, positions, predicates and targets, and the replacement maps.

    ``reports`` needs a unique ``report_key``.  Positions without targets are dropped, (position,
    stakeholder) is kept once, by report and ordinal.
    """
    cfg = cfg or PostProcessConfig()
    keep = [c for c in reports.columns if c != "positions"]
    pos = with_members(explode_positions(reports.select(*[F.col(f"`{c}`") for c in keep], "positions"), [f"`{c}`" for c in keep]), "targets")
    pos = pos.withColumn("ord", order_key("report_key", "pos_no")).withColumn("stakeholder", normalize_text("stakeholder"))
    first = pos = materialize(pos, "pp-positions")
    table = materialize(anchor_table(anchors), "pp-anchors")
    link = lambda occ, t: link_entities(occ, table, kb, LinkConfig(threshold=t, voting=cfg.voting, method=cfg.method))
    who = link(pos.select("ord", F.col("stakeholder").alias("name")), cfg.stakeholders)
    pos = pos.join(who["occurrences"].select("ord", "final", F.struct("item_id", "page_id").alias("linked")), "ord", "left").withColumn("stakeholder", F.coalesce("final", "stakeholder")).drop("final")
    pmap = materialize(cluster_texts(pos, "position", cfg.positions, cfg.encoder, cfg.method), "pp-position-map")
    pos = materialize(replace_by_canonical(pos, "position", pmap), "pp-replaced")
    release(first)
    t = explode_targets(pos, ["ord"]).withColumn("t_ord", F.concat("ord", order_key("target_no")))
    t = materialize(t, "pp-targets")
    whom = link(t.select(F.col("t_ord").alias("ord"), F.col("target").alias("name")), cfg.targets)
    t = t.join(whom["occurrences"].select(F.col("ord").alias("t_ord"), "final"), "t_ord", "left").withColumn("target", F.coalesce("final", "target")).drop("final")
    rmap = materialize(cluster_texts(t, "predicate", cfg.predicates, cfg.encoder, cfg.method), "pp-predicate-map")
    t = replace_by_canonical(t, "predicate", rmap)
    grouped = regroup(t, ["ord"], "target_no", ["predicate", "target", "stance_type"])
    clean = pos.withColumnRenamed("targets", "old_targets").join(grouped, "ord")
    if "country_code" in clean.columns:
        clean = clean.withColumn("country_code", F.upper("country_code"))
    cleaned = keep_first(clean, ["position", "stakeholder"], ["ord"])
    return {"cleaned": cleaned, "stakeholders": who["names"], "targets": whom["names"], "positions": pmap, "predicates": rmap, "conflicts": who["conflicts"]}
