"""Entity linking: names -> anchors by voting of several models, then clusters and canonical names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.text import augmented_entity, kb_description_text, order_key
from ..session import materialize, release, spread
from .clustering import METHODS, cluster, conflicting, propagate, vector_communities
from .vectors import embed, hashed_embedding, joint_models, knn, similarity_pairs
from .voting import MODES, elect, votes

Encoder = Callable[[list[str]], np.ndarray]


def default_models() -> dict[str, Encoder]:
    """Two offline text models of different size and hashing."""
    return {"trigram_96": hashed_embedding(96, 3, 1), "fourgram_64": hashed_embedding(64, 4, 2)}


@dataclass
class LinkConfig:
    """Parameters of the linker; thresholds are distances (1 - cosine)."""

    threshold: float = 0.3
    top_k: int = 5
    voting: str = "all"
    method: str = "fast"
    models: dict[str, Encoder] = field(default_factory=default_models)

    def __post_init__(self) -> None:
        if self.voting not in MODES:
            raise ValueError(f"unknown voting {self.voting!r}")
        if self.method not in METHODS:
            raise ValueError(f"unknown clustering method {self.method!r}")


def elect_links(queries: DataFrame, corpus: DataFrame, cfg: LinkConfig) -> DataFrame:
    """``(u, row_id)``: the corpus row each query ``(u, text)`` is linked to, if the models' vote gives one.

    kNN runs per model first and the vote counts membership in the lists, so a model whose list misses
    a candidate speaks against it.  Where all models must agree, a score below the threshold speaks against it as well
    as a missing one, so the lists end there.
    """
    rank = F.create_map(*[F.lit(x) for i, m in enumerate(cfg.models) for x in (m, i)])
    q = materialize(embed(spread(queries.select("u", "text")), "text", cfg.models), "link-queries")
    c = materialize(embed(spread(corpus.select("row_id", "text")), "text", cfg.models), "link-corpus")
    near = knn(q, c, cfg.top_k, "u", "row_id", "embedding", by=["model"], min_score=1.0 - cfg.threshold if cfg.voting == "all" else None).withColumn("model_rank", F.element_at(rank, F.col("model")))
    won = elect(votes(near, "u", "row_id", cfg.top_k), "u", "row_id", len(cfg.models), cfg.threshold, cfg.voting)
    won = materialize(won.select("u", "row_id"), "link-won")
    release(q, c)
    return won


def link_entities(occurrences: DataFrame, anchors: DataFrame, kb: DataFrame, cfg: LinkConfig | None = None) -> dict[str, DataFrame]:
    """Link and cluster the names of ``occurrences (ord, name)``.

    ``anchors`` has ``row_id, normalized_anchor_text, target_item_id, target_page_id``; ``kb`` the reference
    items.  Names are matched with the anchors; what is missing is matched with all names and descriptions
    of the items found so far; then all names, enriched by their item, are clustered by the mean cosine
    of the models, and an item spreads to unlinked members of its cluster.  Returns ``names (name, u,
    cnt, item_id, page_id, center, final)``, ``occurrences (ord, name, final, item_id, page_id)``, ``clusters``
    and ``conflicts``.  An empty anchor or item table simply links nothing.
    """
    cfg = cfg or LinkConfig()
    occ = occurrences.where(F.col("name").isNotNull())
    uniq = materialize(occ.groupBy("name").agg(F.min("ord").alias("u"), F.count("*").alias("cnt")), "link-names")
    anchors = anchors.where(F.col("normalized_anchor_text").isNotNull() & (F.col("normalized_anchor_text") != ""))
    link1 = elect_links(uniq.select("u", F.col("name").alias("text")), anchors.select("row_id", F.col("normalized_anchor_text").alias("text")), cfg)
    link1 = materialize(link1.join(anchors.select("row_id", F.col("target_item_id").alias("item_id"), F.col("target_page_id").alias("page_id")), "row_id").where("item_id is not null").select("u", "item_id", "page_id"), "link-one")
    empty = F.array().cast("array<string>")
    texts = F.concat(F.coalesce("labels", empty), F.array(kb_description_text("main_label", "description")), F.coalesce("aliases", empty))
    found = link1.groupBy("item_id").agg(F.min("page_id").alias("page_id"))
    corpus = found.join(kb, "item_id").select("item_id", "page_id", F.posexplode(texts).alias("pos", "text")).where("text is not null and text <> ''")
    corpus = materialize(corpus.withColumn("row_id", order_key("item_id", "pos")), "link-kb")
    missing = materialize(uniq.join(link1, "u", "left_anti").select("u", F.col("name").alias("text")), "link-missing")
    link2 = elect_links(missing, corpus, cfg).join(corpus.select("row_id", "item_id", "page_id"), "row_id").select("u", "item_id", "page_id")
    link = link1.unionByName(link2)
    info = kb.select("item_id", F.nullif("main_label", F.lit("")).alias("main_label"), "description", "en_aliases")
    named = uniq.join(link, "u", "left").join(info, "item_id", "left")
    aug = F.when(F.col("main_label").isNotNull(), augmented_entity("main_label", "description", "en_aliases")).otherwise(F.lower("name"))
    named = materialize(named.withColumn("aug", aug), "link-augmented")
    vec = embed(spread(named.select("u", "aug")), "aug", cfg.models).groupBy("u").pivot("model", list(cfg.models)).agg(F.first("embedding"))
    joint = materialize(vec.select("u", joint_models([F.col(f"`{m}`") for m in cfg.models]).alias("v")), "link-vectors")
    items = named.select(F.col("u").alias("i"))
    pairs = materialize(similarity_pairs(joint, "u", "v", 1.0 - cfg.threshold), "link-pairs")
    members = materialize(cluster(items, pairs, cfg.threshold, cfg.method), "link-members")
    release(joint, pairs)
    labels = named.where("item_id is not null").select(F.col("u").alias("item"), F.struct("item_id", "page_id").alias("label"))
    labelled = propagate(members, labels)
    canonical = named.select(F.col("u").alias("canonical"), F.col("name").alias("canonical_name"))
    out = named.select("name", "u", "cnt").join(labelled.select(F.col("item").alias("u"), F.col("label.item_id").alias("item_id"), F.col("label.page_id").alias("page_id"), "source"), "u")
    out = out.join(members.select(F.col("item").alias("u"), "center", "canonical"), "u").join(canonical, "canonical").join(info.select("item_id", "main_label"), "item_id", "left")
    names = materialize(out.select("name", "u", "cnt", "item_id", "page_id", "source", "center", F.coalesce("main_label", "canonical_name").alias("final")), "link-final")
    result = occ.join(names.select("name", "final", "item_id", "page_id"), "name").select("ord", "name", "final", "item_id", "page_id")
    return {"names": names, "occurrences": result, "clusters": members, "conflicts": conflicting(members, labels.select("item", F.col("label.item_id").alias("label")))}


def hit_rate(names: DataFrame, count: str = "cnt") -> DataFrame:
    """``(occurrences, linked, percent)`` of the names' occurrences."""
    linked = F.sum(F.when(F.col("item_id").isNotNull(), F.col(count)).otherwise(0))
    return names.agg(F.sum(count).alias("occurrences"), linked.alias("linked"), F.round(100.0 * linked / F.sum(count), 2).alias("percent"))


def cluster_texts(texts: DataFrame, col: str, threshold: float, encoder: Encoder, method: str = "fast") -> DataFrame:
    """``(item, canonical)`` texts: distinct texts clustered by one model, degrees weighted by occurrence."""
    uniq = texts.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("text")).agg(F.count("*").alias("w"))
    # numbers in the order of the texts stand for them in the pairs
    uniq = materialize(uniq.orderBy("text").withColumn("i", F.monotonically_increasing_id()), "texts")
    v = materialize(embed(spread(uniq.select("i", "w", "text")), "text", {"m": encoder}).select("i", "w", F.col("embedding").alias("v")), "text-vectors")
    if method == "fast":
        m = vector_communities(v, threshold)
        release(v)
    else:
        pairs = materialize(similarity_pairs(v, "i", "v", 1.0 - threshold), "text-pairs")
        m = cluster(uniq.select("i", "w"), pairs, threshold, method, weight="w")
    item, canonical = (uniq.select(F.col("i").alias(x), F.col("text").alias(f"_{x}")) for x in ("item", "canonical"))
    return m.join(item, "item").join(canonical, "canonical").select(F.col("_item").alias("item"), F.col("_canonical").alias("canonical"))
