"""Spellings that mean the same person, body or place.

Tokens of all names are joined with each other by the trie join; a rare token
within the bound of a frequent one is read as that one.  Roles of tokens are
learned from how they are used.  Names then meet by their form: the order of
tokens does not matter, titles and initials are no part of it.  A name that gives
only a family name, or an initial, belongs to the one person it fits, and to none
if it fits several.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .names import KIND, PLACE, STOPS, TITLE, Roles, Tokens, form, full_names, is_code, read
from .trie_join import trie_join


def token_rows(names: DataFrame) -> DataFrame:
    """``(name, weight, tok array, raw array, comma)`` of distinct names."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            t = [read(n) for n in pdf["name"]]
            yield pd.DataFrame({"name": pdf["name"], "weight": pdf["weight"], "tok": [list(x.tok) for x in t], "raw": [list(x.raw) for x in t], "comma": [x.comma for x in t]})

    return names.mapInPandas(run, "name string, weight long, tok array<string>, raw array<string>, comma int")


def respell(rows: DataFrame) -> DataFrame:
    """``(word, canon)``: tokens to be read as a more frequent one nearby.

    Words of at least 5 letters within one edit, then words of at least 8 still without a
    counterpart within two.  A token is read as its heaviest neighbour if that occurs in eight times as
    many names, or if the token itself is rare; chains are followed.
    """
    w = rows.select(F.explode("tok").alias("word"), "weight").groupBy("word").agg(F.sum("weight").alias("rows"), F.count("*").alias("names"))
    w = materialize(w.where((F.length("word") >= 5) & ~F.col("word").rlike("[0-9]")).withColumn("w", F.col("names") * 4 + F.least("rows", F.col("names") * 8)), "name-tokens")
    one = trie_join(w.select("word"), w.select("word"), 1)
    heavy = w.select(F.col("word").alias("other"), F.col("w").alias("ow"), F.col("names").alias("onames"))

    def choose(pairs: DataFrame) -> DataFrame:
        c = pairs.select(F.col("query").alias("word"), F.col("word").alias("other"), "distance").join(w, "word").join(heavy, "other")
        ok = (F.col("onames") >= 8 * F.col("names")) | ((F.col("names") <= 2) & ((F.col("ow") > F.col("w")) | ((F.col("ow") == F.col("w")) & (F.col("other") < F.col("word")))))
        best = Window.partitionBy("word").orderBy("distance", F.desc("ow"), "other")
        return c.where(ok).withColumn("r", F.row_number().over(best)).where("r = 1").select("word", F.col("other").alias("canon"))

    near = materialize(choose(one), "name-near")
    lone = w.join(near, "word", "left_anti").where((F.length("word") >= 8) & (F.col("names") <= 3))
    strong = w.where((F.length("word") >= 7) & (F.col("names") >= 2)).select("word")
    far = choose(trie_join(lone.select("word"), strong, 2))
    step = materialize(near.unionByName(far), "name-step")
    while True:  # chains halve in every round
        nxt = step.select(F.col("word").alias("canon"), F.col("canon").alias("up"))
        step = materialize(step.join(nxt, "canon", "left").select("word", F.coalesce("up", "canon").alias("canon"), F.col("up").isNotNull().alias("more")).where("word <> canon"), "name-step")
        if not step.where("more").limit(1).count():
            return step.select("word", "canon")


def spelled(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """The rows with every token replaced by its canonical one."""
    each = rows.select("name", F.posexplode("tok").alias("i", "word")).join(canon, "word", "left")
    again = each.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("canon", "word").alias("t")))).alias("x")).select("name", F.col("x.t").alias("tok"))
    return rows.drop("tok").join(again, "name")


def learn_roles(rows: DataFrame, typed: DataFrame) -> Roles:
    """Fields, countries and given names, from the company tokens keep; the whole sets, one entry a token of that role.

    ``typed`` has the tokens as typed: countries are what adjectives such as those in -n, -ic and -ish are made of.
    """
    kinds, skip = list(KIND), [*TITLE, *PLACE, *STOPS]
    t = rows.select("name", "tok", F.exists("tok", lambda x: x.isin(kinds)).alias("body"), F.size("tok").alias("n"))
    each = t.select("name", "body", "n", "tok", F.explode("tok").alias("t")).where((F.length("t") > 2) & ~F.col("t").isin(kinds + skip))
    partner = F.filter("tok", lambda x: (x != F.col("t")) & ~x.isin(kinds + skip) & (F.length(x) > 2))
    use = each.select("t", "body", F.when(F.size(partner) == 1, F.element_at(partner, 1)).alias("p"))
    pairs = use.where("p is not null").groupBy("t", "body", "p").agg(F.count("*").alias("c"))
    deg = pairs.groupBy("t").agg(
        F.count(F.when(F.col("body"), 1)).alias("body_partners"), F.count(F.when(~F.col("body"), 1)).alias("free_partners"))
    deg = materialize(deg, "name-degrees")
    back = pairs.where("body").join(deg.select(F.col("t").alias("p"), F.col("body_partners").alias("pd")), "p").groupBy("t").agg(F.avg("pd").alias("partner_degree"))
    # fields of bodies meet many places that themselves meet few fields; countries meet many fields and places alike
    body = back.join(deg, "t").where("body_partners >= 3")
    f = body.where("body_partners >= 3 * partner_degree and free_partners <= body_partners").select("t").toPandas()
    # a given name meets many family names, which meet few given names; a family name of many spellings is met by given names that meet many
    free = pairs.where("not body").join(deg.select(F.col("t").alias("p"), F.col("free_partners").alias("pf")), "p").groupBy("t").agg(F.avg("pf").alias("free_degree"))
    given = deg.join(free, "t").where("free_partners >= 4 and free_partners > 2 * body_partners and free_partners > free_degree").select("t").toPandas()
    adj = typed.select(F.explode("tok").alias("t")).distinct()
    stem = None
    for suf in ("n", "ik", "is"):
        s = adj.where(F.col("t").endswith(suf) & (F.length("t") > 5)).select(F.expr(f"substring(t, 1, length(t) - {len(suf)})").alias("t"))
        stem = s if stem is None else stem.unionByName(s)
    land = stem.distinct().join(deg.where("body_partners >= 2"), "t").select("t").toPandas()
    countries = frozenset(land["t"]) - frozenset(given["t"])
    fields = frozenset(f["t"]) - countries
    return Roles(frozenset(t for t in given["t"] if t not in fields and not is_code(t, fields)), fields, countries)


def name_forms(rows: DataFrame, roles: Roles) -> DataFrame:
    """``(name, weight, kind, a, b, c, initial, alts, sure)``; alts: the given names a nickname may stand for; sure: the given name is a whole one."""
    held = rows.sparkSession.sparkContext.broadcast(roles)  # one entry a token of a role

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        r = held.value
        for pdf in batches:
            f = [form(Tokens(tuple(t), int(c), tuple(w)), r) for t, c, w in zip(pdf["tok"], pdf["comma"], pdf["raw"])]
            out = []
            for x in f:
                full = full_names(x.b) if x.kind == "person" and x.b else frozenset()
                alts = sorted(full - {x.b})
                out.append((x.kind, x.a, x.b, x.c, x.initial, alts, not alts and (len(x.b) > 4 or x.b in r.given)))
            yield pd.concat([pdf[["name", "weight"]].reset_index(drop=True), pd.DataFrame(out, columns=["kind", "a", "b", "c", "initial", "alts", "sure"])], axis=1)

    return rows.select("name", "weight", "tok", "raw", "comma").mapInPandas(run, "name string, weight long, kind string, a string, b string, c string, initial string, alts array<string>, sure boolean")


def entities(forms: DataFrame) -> DataFrame:
    """``(name, entity)``; names whose form fits several entities stand alone."""
    persons = forms.where("kind = 'person'")
    known = persons.where("b <> '' and sure").groupBy("a").agg(F.collect_set("b").alias("givens"))
    # a single word is the family name of a person if there is one of that name, else a place
    single = forms.where("kind = 'single'").join(persons.select("a").distinct().withColumn("person", F.lit("person")), "a", "left")
    single = single.withColumn("kind", F.coalesce("person", F.lit("place"))).select(*forms.columns)
    persons = persons.unionByName(single.where("kind = 'person'"))
    p = persons.join(known, "a", "left").withColumn("givens", F.coalesce("givens", F.array().cast("array<string>")))
    # a folded "ph" begins with f
    fits = F.filter("givens", lambda g: g.startswith(F.col("initial")) | (F.col("initial") == "") | (F.col("initial") == "p") & g.startswith("f"))
    # a cut given name ("yev.") stands for the one it begins
    longer = F.filter("givens", lambda g: g.startswith(F.col("b")) & (F.length(g) > F.length("b") + 1))
    meant = F.array_intersect("givens", "alts")
    cut = (F.col("b") != "") & ~F.col("sure") & (F.length("b") <= 4) & (F.size(longer) == 1)
    b = F.when(F.size(meant) == 1, F.element_at(meant, 1)).when(cut, F.element_at(longer, 1)).when(F.size("alts") == 1, F.element_at("alts", 1)).otherwise(F.col("b"))
    p = p.withColumn("fits", fits).withColumn("b", b)
    given = F.when(F.col("b") != "", F.col("b")).when(F.size("fits") == 1, F.element_at("fits", 1)).when(F.size("givens") == 0, F.lit("?")).otherwise(F.concat(F.lit("!"), "name"))
    # of a family name without any given name, the initials tell persons apart
    lone = persons.where("b = '' and initial <> ''").groupBy("a").agg(F.collect_set("initial").alias("inits"))
    p = p.withColumn("g", given).join(lone, "a", "left")
    g = F.when((F.col("g") == "?") & (F.size(F.coalesce("inits", F.array().cast("array<string>"))) > 1), F.when(F.col("initial") != "", F.concat(F.lit("?"), "initial")).otherwise(F.concat(F.lit("!"), "name"))).otherwise(F.col("g"))
    people = p.select("name", F.concat_ws("|", F.lit("person"), "a", g).alias("entity"))
    bodies = forms.where("kind = 'body'")
    full = bodies.where("c <> ''").select("a", F.col("b").alias("fb"), F.col("c").alias("fc")).distinct()
    short = bodies.where("c = ''").join(full, "a").where((F.col("b") == F.col("fb")) & (F.substring("fc", 1, 1) == F.col("initial")))
    short = short.groupBy("name", "a", "b").agg(F.collect_set("fc").alias("c")).where("size(c) = 1").select("name", "a", "b", F.element_at("c", 1).alias("c"))
    bodies = bodies.where("c <> ''").select("name", "a", "b", "c").unionByName(short)
    bodies = bodies.select("name", F.concat_ws("|", F.lit("body"), "a", "b", "c").alias("entity"))
    rest = forms.where("kind in ('place', 'other')").unionByName(single.where("kind = 'place'")).select("name", F.concat_ws("|", "kind", "a").alias("entity"))
    out = people.unionByName(bodies).unionByName(rest)
    alone = forms.join(out, "name", "left_anti").select("name", F.concat(F.lit("!"), "name").alias("entity"))
    return out.unionByName(alone)


def name_variants(values: DataFrame, column: str) -> DataFrame:
    """``(name, entity, weight)``: one row per distinct spelling with the entity it means.

    Spellings are lower-cased and stripped of outer white space first; null and blank values are
    left out, repeated ones count towards the weight; an empty table gives an empty result.
    """
    name = F.regexp_replace(F.lower(F.col(column)), r"(?U)^\s+|\s+$", "")
    names = values.select(name.alias("name")).where("name is not null and name <> ''").groupBy("name").agg(F.count("*").alias("weight"))
    typed = materialize(token_rows(names), "name-rows")
    rows = materialize(spelled(typed, respell(typed)), "name-spelled")
    forms = materialize(name_forms(rows, learn_roles(rows, typed)), "name-forms")
    return entities(forms).join(forms.select("name", "weight"), "name")
