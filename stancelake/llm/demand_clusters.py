"""Similarity clusters of short statements: grid density clustering in SQL.

A statement is read as its names and its informative words, whatever its
sentence looks like.  Names are the words the corpus writes with a capital inside
a sentence; informative are the words that few statements use.  Both are quantised:
a word falls on the frequent word it is a misspelling of.  The grid has two axes,
the name and a hashed pair of neighbouring informative words; a cell is one value of
each.  Cells are counted over distinct wordings, a cell is dense if it holds far more
than its two coordinates would give by chance, adjacent dense cells (they hold the
same wordings) are joined, and the smallest label spreads until nothing changes.  A
wording belongs to the label most of its cells carry.  A cluster is described by its
size and by the wordings of its densest cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.graph import connected_components
from ..session import materialize, release

WORD = r"[\p{L}\p{N}]+"
#: A word is common, and no coordinate, if more than this share of the wordings use it; the share counts PRIOR wordings more.
COMMON, PRIOR = 0.05, 400
#: From this share of the wordings on, a name's own wordings are left out when its words are told common.
HOT = 0.005
#: A word is a name if this share of its occurrences inside mixed-case statements has a capital.
CAPITAL = 0.5
#: A word is read as one that it is a single edit away from if that has DOMINANT times the wordings, or if it has at most RARE itself.
RARE, DOMINANT = 2, 5
#: A dense cell holds at least LIFT times what the rest of the corpus leads to expect; two dense cells are adjacent beyond this overlap.
LIFT, OVERLAP = 1.5, 0.5


def wordings(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(wid, n, first, text)``: the distinct texts, lower-cased and stripped, with their number of rows and smallest id."""
    t = F.trim(text_col)
    kept = rows.where(F.col(text_col).isNotNull() & (t != "")).select(F.col(id_col).cast("long").alias("id"), t.alias("text"))
    return kept.groupBy(F.xxhash64(F.lower("text")).alias("wid")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("text").alias("text"))


def word_rows(texts: DataFrame) -> DataFrame:
    """``(wid, pos, w, cap)``: the words of every wording; ``cap`` is null where the case says nothing."""
    w = texts.select("wid", ((F.col("text") != F.lower("text")) & (F.col("text") != F.upper("text"))).alias("mixed"), F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "raw"))
    return w.select("wid", "pos", F.lower("raw").alias("w"), F.when(F.col("mixed") & (F.col("pos") > 0), (F.col("raw") != F.lower("raw")).cast("int")).alias("cap")).where(F.length("w") > 1)


def vocabulary(words: DataFrame) -> DataFrame:
    """``(w, canon, n, name)``: every word, the word it is read as, that word's wordings and whether it is a name."""
    v = words.groupBy("w").agg(F.count("*").alias("n"), F.sum("cap").alias("caps"), F.count("cap").alias("seen"))
    v = materialize(v, "demand-words")
    near = _near(v.where(F.length("w") >= 4))
    for _ in range(2):  # each step leads to a word at least DOMINANT times as frequent
        up = near.select(F.col("w").alias("canon"), F.col("canon").alias("up"))
        near = materialize(near.join(up, "canon", "left").select("w", F.coalesce("up", "canon").alias("canon")).where("w <> canon"), "demand-near")
    full = v.join(near, "w", "left").withColumn("canon", F.coalesce("canon", "w"))
    total = full.groupBy("canon").agg(F.sum("n").alias("n"), (F.sum("caps") >= CAPITAL * F.sum("seen")).alias("name"))
    return materialize(full.select("w", "canon").join(total, "canon").select("w", "canon", "n", F.coalesce("name", F.lit(False)).alias("name")), "demand-vocabulary")


def _near(v: DataFrame) -> DataFrame:
    """``(w, canon)`` by what is left of two words after at most one deletion in each: an edit, or a letter that moved."""
    cut = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring("w", F.lit(1), i - 1), F.substring("w", i + 1, F.lit(1 << 20))))
    rests = v.select("w", "n", F.explode(F.array_distinct(F.transform(F.concat(F.array("w"), cut), lambda x: F.xxhash64(x)))).alias("rest"))
    # the words that share a rest differ in one letter, so there are at most a few hundred
    met = rests.groupBy("rest").agg(F.max(F.struct("n", "w")).alias("top"), F.collect_list(F.struct("n", "w")).alias("all")).where("size(all) > 1")
    met = met.select(F.explode("all").alias("x"), "top").select("x.w", "x.n", F.col("top.w").alias("canon"), F.col("top.n").alias("m")).where("w <> canon")
    met = met.where((F.col("m") >= DOMINANT * F.col("n")) | (F.col("n") <= RARE))
    return met.groupBy("w").agg(F.max_by("canon", F.struct("m", "canon")).alias("canon"))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def grid(texts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``(wid, names, pairs)``, the coordinates of every wording: its names and its hashed pairs of informative words; and ``(a, s)``, the names."""
    words = word_rows(texts)
    voc = vocabulary(words)
    t = words.join(voc, "w").select("wid", "pos", F.xxhash64("canon").alias("h"), "name", F.col("n").alias("nv"))
    limit = COMMON * (total + PRIOR)
    kept = t.where(F.col("name") | (F.col("nv") <= limit))
    # words that are frequent only because a name is: counted outside that name's wordings
    hot = t.where(F.col("name") & (F.col("nv") >= HOT * total)).select("wid", F.col("h").alias("a"), F.col("nv").alias("na")).distinct()
    usual = t.where(~F.col("name") & (F.col("nv") > limit)).join(hot, "wid")
    usual = materialize(usual.select("wid", "pos", "h", "nv", "a", "na"), "demand-usual")
    own = usual.groupBy("a", "h").agg(F.count_distinct("wid").alias("nav"), F.first("nv").alias("nv"), F.first("na").alias("na"))
    own = own.where(F.col("nv") - F.col("nav") <= COMMON * (F.lit(total + PRIOR) - F.col("na"))).select("a", "h")
    more = usual.join(own, ["a", "h"]).select("wid", "pos", "h", F.lit(False).alias("name"), "nv").distinct()
    per = kept.unionByName(more).groupBy("wid").agg(
        F.sort_array(F.collect_list(F.when(~F.col("name"), F.struct("pos", "h")))).alias("seq"), F.collect_set(F.when(F.col("name"), F.struct(F.col("h").alias("a"), F.col("nv").alias("na")))).alias("names"))
    steps = F.when(F.size("seq") > 1, F.sequence(F.lit(1), F.size("seq") - 1)).otherwise(F.array().cast("array<int>"))
    s = F.col("seq")
    pairs = F.transform(steps, lambda i: F.when(s[i]["pos"] - s[i - 1]["pos"] <= 2, _pair(s[i]["h"], s[i - 1]["h"])))
    return per.select("wid", "names", F.array_distinct(F.filter(pairs, lambda p: p.isNotNull())).alias("pairs")).where("size(names) > 0 and size(pairs) > 0"), voc.where("name").select(F.xxhash64("canon").alias("a"), F.col("canon").alias("s")).distinct()


def dense_cells(coords: DataFrame, total: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``held (wid, a, b, cell, c)``, ``lone (wid, a, na, b)`` and ``cells (cell, a, na, b, c)``; ``coords`` is read to the end and released.

    ``cells`` are the dense ones.  A wording is held by the dense cells of its principal name, the one
    that its cells fill most; wordings without any are lone.
    """
    each = coords.select("wid", F.explode("names").alias("x"), "pairs").select("wid", F.col("x.a").alias("a"), F.col("x.na").alias("na"), F.explode("pairs").alias("b"))
    stored = materialize(each, "demand-grid")
    each = stored.withColumn("cell", F.xxhash64("a", "b"))
    often = coords.select(F.explode("pairs").alias("b")).groupBy("b").agg(F.count("*").alias("nb")).where("nb > 1")
    count = each.groupBy("cell", "a", "b").agg(F.count("*").alias("c"), F.first("na").alias("na")).where("c > 1").join(often, "b")
    outside = (F.col("nb") - F.col("c") + COMMON * 10) / (F.greatest(F.lit(total) - F.col("na"), F.lit(0)) + 10)
    cells = materialize(count.where(F.col("c") / F.col("na") >= LIFT * outside).select("cell", "a", "na", "b", "c"), "demand-cells")
    full = each.join(cells.select("cell", "c"), "cell", "left")
    per = full.groupBy("wid", "a", "na").agg(F.max(F.coalesce("c", F.lit(1))).alias("top"), F.collect_list(F.struct("b", "cell", "c")).alias("own"))
    main = per.groupBy("wid").agg(F.max_by(F.struct("a", "na", "own"), F.struct(F.col("top") / F.col("na"), "top", "a")).alias("m"))
    main = materialize(main.select("wid", "m.a", "m.na", F.filter("m.own", lambda x: x["c"].isNotNull()).alias("dense"), "m.own"), "demand-main")
    release(stored, coords)
    held = main.select("wid", "a", F.explode("dense").alias("x")).select("wid", "a", "x.b", "x.cell", "x.c")
    lone = main.where("size(dense) = 0").select("wid", "a", "na", F.explode("own").alias("x")).select("wid", "a", "na", "x.b")
    return held, lone, cells


def adjacent(held: DataFrame, cells: DataFrame) -> DataFrame:
    """``(src, dst)``: dense cells of a name that hold the same wordings.

    A link stands if it is seen in more than OVERLAP of the larger cell: no two demands of a name that share some words
    by chance can both be linked to the cell of those words.
    """
    per = held.groupBy("wid").agg(F.sort_array(F.collect_list("cell")).alias("own")).where("size(own) > 1")
    each = per.select("own", F.posexplode("own").alias("i", "src")).select("src", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("dst"))
    seen = each.groupBy("src", "dst").agg(F.count("*").alias("n"))
    size = cells.select(F.col("cell").alias("src"), F.col("c").alias("cs"))
    seen = seen.join(size, "src").join(size.toDF("dst", "cd"), "dst")
    return seen.where(F.col("n") > OVERLAP * F.greatest("cs", "cd")).select("src", "dst")


def misspelt(asked: DataFrame, cells: DataFrame, names: DataFrame) -> DataFrame:
    """``(key, cell)``: the dense cell along the name's axis that ``asked (key, a, na, b)`` is a misspelling of.

    Both have the same pair of words, and the names are within two edits and agree in one of three
    stretches of letters; of several cells the nearest and densest is taken.
    """
    blocks = F.explode(F.array(F.xxhash64("b", F.substring("s", 1, 3)), F.xxhash64("b", F.expr("substring(s, -8, 4)"), F.lit(1)), F.xxhash64("b", F.expr("substring(s, -12, 4)"), F.lit(2))))
    known = names.where(F.length("s") >= 8)
    ask = asked.join(known, "a").select("key", "a", "na", "b", "s", blocks.alias("block"))
    held = cells.join(known, "a").select(blocks.alias("block"), F.col("a").alias("ta"), F.col("na").alias("tn"), "cell", "c", F.col("b").alias("tb"), F.col("s").alias("t"))
    met = ask.join(held, "block").where("a <> ta and b = tb").where((F.col("tn") >= DOMINANT * F.col("na")) | (F.col("na") <= RARE) & (F.col("tn") > F.col("na")))
    met = met.withColumn("d", F.levenshtein("s", "t")).where("d <= 2")
    return met.groupBy("key").agg(F.min_by("cell", F.struct("d", -F.col("c"), "cell")).alias("cell"))


def clusters(rows: DataFrame, id_col: str, text_col: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """``members (id, cluster_id, wid, cell)`` and ``found (cluster_id, size, wordings)``.

    ``cluster_id`` is the smallest id of the cluster; clusters of fewer than ``least`` rows are left
    out.  Null and empty texts are in no cluster; copies of one text always meet; a text without a
    name or without informative words meets only its copies; repeated rows count each; an empty table
    gives empty results.
    """
    texts = materialize(wordings(rows, id_col, text_col), "demand-texts")
    total = texts.count()
    coords, names = grid(texts, total)
    held, lone, cells = dense_cells(materialize(coords, "demand-coordinates"), total)
    lone = lone.select(F.col("wid").alias("key"), "a", "na", "b")
    spelt = materialize(misspelt(lone, cells, names), "demand-spelt")
    turned = misspelt(cells.select(F.col("cell").alias("key"), "a", "na", "b"), cells, names).toDF("src", "dst")
    comp = connected_components(adjacent(held, cells).unionByName(turned), "src", "dst").withColumnsRenamed({"vertex": "cell", "component": "label"})
    comp = comp.join(comp.groupBy("label").agg(F.count("*").alias("many")), "label")
    every = held.select("wid", "cell", "c").unionByName(spelt.select(F.col("key").alias("wid"), "cell", F.lit(1).cast("long").alias("c")))
    voted = every.join(comp, "cell", "left").withColumn("label", F.coalesce("label", "cell")).groupBy("wid", "label").agg(F.count("*").alias("k"), F.max("many").alias("many"), F.sum("c").alias("c"), F.max_by("cell", F.struct("c", "cell")).alias("cell"))
    vote = voted.groupBy("wid").agg(F.max_by(F.struct("label", "cell"), F.struct("k", "many", "c", "label")).alias("v")).select("wid", "v.label", "v.cell")
    placed = materialize(texts.select("wid", "n", "first").join(vote, "wid", "left").withColumn("label", F.coalesce("label", "wid")), "demand-placed")
    found = placed.groupBy("label").agg(F.sum("n").alias("size"), F.min("first").alias("cluster_id"), F.count("*").alias("wordings")).where(F.col("size") >= least)
    found = materialize(found, "demand-clusters")
    ids = rows.where(F.col(text_col).isNotNull() & (F.trim(text_col) != "")).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.lower(F.trim(text_col))).alias("wid"))
    members = ids.join(placed.join(found.select("label", "cluster_id"), "label").select("wid", "cluster_id", "cell"), "wid")
    return members.select("id", "cluster_id", "wid", "cell"), found.select("cluster_id", "size", "wordings")


def describe(members: DataFrame, found: DataFrame, rows: DataFrame, id_col: str, text_col: str, top: int = 3) -> DataFrame:
    """``(cluster_id, size, wordings, typical)``: size and the most frequent wordings of the densest cell."""
    per = members.groupBy("cluster_id", "cell").agg(F.count("*").alias("n"))
    dense = per.groupBy("cluster_id").agg(F.max_by("cell", F.struct("n", "cell")).alias("dense"))
    text = rows.select(F.col(id_col).cast("long").alias("id"), F.lower(F.trim(text_col)).alias("t"))
    count = members.join(dense, "cluster_id").where("cell <=> dense").join(text, "id").groupBy("cluster_id", "t").agg(F.count("*").alias("c"))
    r = Window.partitionBy("cluster_id").orderBy(F.desc("c"), "t")
    typical = count.withColumn("r", F.row_number().over(r)).where(F.col("r") <= top).groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " | ").alias("typical"))
    return found.join(typical, "cluster_id")
