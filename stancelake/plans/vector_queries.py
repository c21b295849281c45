"""Queries of the vector core: neighbours, votes, clusters, linking, topics, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import normalize_text
from ..operators import clustering, evaluate, topics, vectors, voting
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL counterpart."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CUT = 0.3
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_PAIRS = f"{_E}, s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {CUT})"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding", "label")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similarity_pairs(_embeddings(spark, d), "vec_id", "embedding", CUT)


@query(f"WITH {_PAIRS} SELECT i, j, round(s, 6) AS s FROM s")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("i", "j", F.round("s", 6).alias("s"))


@query(f"""WITH {_E}, k AS (SELECT a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT q AS query_id, c AS vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS INTEGER) AS rank, round(s, 6) AS score FROM k QUALIFY rank <= 5""")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return vectors.knn(q, e, 5, "query_id", "vec_id", "embedding", exclude_self=True).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {_E}, m AS (SELECT a.vec_id AS i, b.vec_id AS j, (list_cosine_similarity(a.v[1:32], b.v[1:32]) + list_cosine_similarity(a.v[33:64], b.v[33:64])) / 2 AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)
SELECT i, j, round(s, 6) AS s FROM m WHERE s >= {CUT}""")
def multi_model_avg(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of two models (the two halves of the vectors), before the threshold."""
    e = _embeddings(spark, d).select("vec_id", vectors.joint_models([F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)]).alias("v"))
    return vectors.similarity_pairs(e, "vec_id", "v", CUT).select("i", "j", F.round("s", 6).alias("s"))


_MODELS = {"m0": (1, 21), "m1": (22, 21), "m2": (43, 22)}
_VOTE_T, _VOTE_K = 0.6, 10
_VOTES = f"""{_E}, w AS (SELECT vec_id, v, unnest([0, 1, 2]) AS m FROM e), x AS (SELECT vec_id, m, v[[1, 22, 43][m + 1]:[21, 42, 64][m + 1]] AS u FROM w),
n AS (SELECT a.vec_id AS q, b.vec_id AS c, a.m, list_cosine_similarity(a.u, b.u) AS s FROM x a JOIN x b ON a.m = b.m AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q, m ORDER BY s DESC, c) AS r FROM n QUALIFY r <= {_VOTE_K}),
g AS (SELECT q, c, count(*) AS n, min(s) AS mn, max(s) AS mx, min(m * {_VOTE_K} + r) AS f FROM k GROUP BY 1, 2)"""
_RULE = {"all": f"n = 3 AND mn >= 1 - {_VOTE_T}", "majority": f"n > 1 AND mn >= 1 - {_VOTE_T}", "any": f"mx >= 1 - {_VOTE_T}"}


def _matches(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other rows of every row, by each of three models."""
    e = _embeddings(spark, d)
    long = e.select("vec_id", F.explode(F.array(*[F.struct(F.lit(i).alias("model_rank"), F.slice("embedding", a, n).alias("v")) for i, (a, n) in enumerate(_MODELS.values())])).alias("x")).select("vec_id", "x.*")
    return vectors.knn(long.withColumnRenamed("vec_id", "query_id"), long, _VOTE_K, "query_id", "vec_id", "v", by=["model_rank"], exclude_self=True)


def _vote(spark: SparkSession, d: str, mode: str) -> DataFrame:
    near = _matches(spark, d)
    won = voting.elect(voting.votes(near, "query_id", "vec_id", _VOTE_K), "query_id", "vec_id", 3, _VOTE_T, mode)
    return won.select("query_id", "vec_id", F.col("n").alias("votes"), F.round("mx", 6).alias("score"))


def _vote_query(mode: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _vote(spark, d, mode)

    run.__name__ = f"vote_{mode}"
    query(f"WITH {_VOTES} SELECT q AS query_id, c AS vec_id, n AS votes, round(mx, 6) AS score FROM g WHERE {_RULE[mode]} QUALIFY row_number() OVER (PARTITION BY q ORDER BY mx DESC, f, c) = 1")(run)


for _mode in voting.MODES:
    _vote_query(_mode)


@query(f"WITH {_VOTES} SELECT q AS query_id, c AS vec_id, round(s, 6) AS score FROM k WHERE m = 1 AND r = 1 AND s >= 1 - {_VOTE_T}")
def vote_single(spark: SparkSession, d: str) -> DataFrame:
    """The second model's first choice alone."""
    return voting.single_model(_matches(spark, d), "query_id", "vec_id", 1, _VOTE_T).withColumn("score", F.round("score", 6))


@query(f"WITH {_VOTES} SELECT q AS query_id, c AS vec_id, round(max(s), 6) AS score FROM k WHERE m < 2 AND r = 1 GROUP BY q, c HAVING count(*) = 2 AND min(s) >= 1 - {_VOTE_T}")
def vote_both(spark: SparkSession, d: str) -> DataFrame:
    """What the first two models both rank first."""
    return voting.agreeing(_matches(spark, d).where("model_rank < 2"), "query_id", "vec_id", 2, _VOTE_T).withColumn("score", F.round("score", 6))


_DOT = f"{_E}, n AS (SELECT a.vec_id AS q, b.vec_id AS c, list_dot_product([x * (1 + a.vec_id % 3) for x in a.v], [x * (1 + b.vec_id % 3) for x in b.v]) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"


@query(f"WITH {_DOT} SELECT q AS query_id, c AS vec_id, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS INTEGER) AS rank, round(s, 6) AS score FROM n QUALIFY rank <= 5")
def knn_dot(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rows by a score function handed in: the dot product of vectors of different length."""
    e = _embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("v"))
    near = vectors.knn(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 5, "query_id", "vec_id", "v", exclude_self=True, score=vectors.dot_score)
    return near.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_E}, t AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS p FROM e WHERE vec_id % 3 <> 0), m AS (SELECT label, p, avg(x) AS x FROM t GROUP BY 1, 2) SELECT label, CAST(p AS INTEGER) AS pos, round(x, 9) AS x FROM m")
def mean_pooling(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each label over the rows its mask admits."""
    e = _embeddings(spark, d).withColumn("counts", F.col("vec_id") % 3 != 0)
    return vectors.mean_pool(e, ["label"], "embedding", "m", "counts").select("label", F.posexplode("m").alias("pos", "x")).withColumn("x", F.round("x", 9))


@query(f"WITH {_E}, t AS (SELECT vec_id, unnest(range(21)) AS p, v FROM e) SELECT vec_id, CAST(p AS INTEGER) AS pos, round((v[p + 1] + v[p + 22] + v[p + 43]) / 3, 9) AS x FROM t")
def mean_of_models(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise mean of three models' vectors."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    m = vectors.mean_vector(*[F.slice(v, a, 21) for a in (1, 22, 43)])
    return _embeddings(spark, d).select("vec_id", F.posexplode(m).alias("pos", "x")).withColumn("x", F.round("x", 9))

_CLUSTERS = f"""{_PAIRS}, b AS (SELECT i, j, s FROM s UNION ALL SELECT j, i, s FROM s UNION ALL SELECT vec_id, vec_id, 1.0 FROM e),
deg AS (SELECT i, count(*) AS deg FROM b GROUP BY 1),
m AS (SELECT b.j AS item, b.i AS center, b.s FROM b JOIN deg USING (i) QUALIFY row_number() OVER (PARTITION BY b.j ORDER BY deg.deg DESC, b.i) = 1),
c AS (SELECT item, center, CAST(row_number() OVER (PARTITION BY center ORDER BY s DESC, item) AS INTEGER) AS rank, first_value(item) OVER (PARTITION BY center ORDER BY s DESC, item) AS canonical FROM m)"""


def _communities(spark: SparkSession, d: str) -> DataFrame:
    return clustering.threshold_communities(_embeddings(spark, d).select(F.col("vec_id").alias("i")), _pairs(spark, d))


@query(f"WITH {_CLUSTERS} SELECT item, center, rank, canonical FROM c")
def community_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _communities(spark, d)


_LABEL = "l AS (SELECT vec_id AS item, label FROM e WHERE vec_id % 3 = 0), f AS (SELECT c.center, l.label, row_number() OVER (PARTITION BY c.center ORDER BY c.rank) AS r FROM c JOIN l USING (item) QUALIFY r = 1)"


@query(f"WITH {_CLUSTERS}, {_LABEL} SELECT c.item, coalesce(l.label, f.label) AS label, CASE WHEN l.label IS NOT NULL THEN 'own' WHEN f.label IS NOT NULL THEN 'cluster' END AS source FROM c LEFT JOIN l USING (item) LEFT JOIN f USING (center)")
def propagate_label(spark: SparkSession, d: str) -> DataFrame:
    labels = _embeddings(spark, d).where("vec_id % 3 = 0").select(F.col("vec_id").alias("item"), "label")
    return clustering.propagate(_communities(spark, d), labels)


@query(f"WITH {_CLUSTERS}, {_LABEL} SELECT c.item, coalesce('label ' || coalesce(l.label, f.label), 'item ' || c.canonical) AS final FROM c LEFT JOIN l USING (item) LEFT JOIN f USING (center)")
def final_naming(spark: SparkSession, d: str) -> DataFrame:
    m = _communities(spark, d)
    labels = _embeddings(spark, d).where("vec_id % 3 = 0").select(F.col("vec_id").alias("item"), "label")
    p = clustering.propagate(m, labels).join(m.select("item", "canonical"), "item")
    return p.select("item", F.coalesce(F.concat(F.lit("label "), F.col("label").cast("string")), F.concat(F.lit("item "), F.col("canonical").cast("string"))).alias("final"))


@query(f"WITH {_CLUSTERS}, {_LABEL} SELECT c.center, string_agg(DISTINCT CAST(l.label AS VARCHAR), ',' ORDER BY CAST(l.label AS VARCHAR)) AS labels FROM c JOIN l USING (item) GROUP BY 1 HAVING count(DISTINCT l.label) > 1")
def conflicting_clusters(spark: SparkSession, d: str) -> DataFrame:
    labels = _embeddings(spark, d).where("vec_id % 3 = 0").select(F.col("vec_id").alias("item"), F.col("label").cast("string").alias("label"))
    return clustering.conflicting(_communities(spark, d), labels).select("center", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {_CLUSTERS}, z AS (SELECT center, count(*) AS n FROM c GROUP BY 1) SELECT count(CASE WHEN n = 1 THEN 1 END) AS outlier_count, CAST(round(100.0 * count(CASE WHEN n = 1 THEN 1 END) / count(*), 2) AS DOUBLE) AS outlier_percentage FROM c JOIN z USING (center)")
def outlier_stats(spark: SparkSession, d: str) -> DataFrame:
    m = _communities(spark, d)
    t = m.join(m.groupBy("center").agg(F.count("*").alias("n")), "center").withColumn("topic", F.when(F.col("n") == 1, -1).otherwise(F.col("center")))
    return topics.outlier_stats(t, "topic").withColumn("outlier_percentage", F.col("outlier_percentage").cast("double"))


@query()
def complete_linkage(spark: SparkSession, d: str) -> DataFrame:
    return clustering.complete_linkage(_embeddings(spark, d).select(F.col("vec_id").alias("i")), _pairs(spark, d), 1 - CUT)


_GOLD = "x AS (SELECT DISTINCT cluster_id AS k, name AS x FROM gold_clusters WHERE name IS NOT NULL), gp AS (SELECT DISTINCT least(a.x, b.x) AS a, greatest(a.x, b.x) AS b FROM x a JOIN x b ON a.k = b.k AND a.x < b.x), gn AS (SELECT DISTINCT least(a.x, b.x) AS a, greatest(a.x, b.x) AS b FROM x a JOIN x b ON a.k < b.k AND a.x <> b.x)"
_PRED = "p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM (SELECT DISTINCT name, split_part(name, ' ', 1) AS t FROM gold_clusters WHERE name IS NOT NULL) a JOIN (SELECT DISTINCT name, split_part(name, ' ', 1) AS t FROM gold_clusters WHERE name IS NOT NULL) b ON a.t = b.t AND a.name < b.name)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold_clusters", "cluster_id", "name").where("name is not null")


@query(f"WITH {_GOLD} SELECT a, b FROM gp")
def gold_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.positive_pairs(_gold(spark, d), "cluster_id", "name")


@query(f"WITH {_GOLD} SELECT count(*) AS n FROM gn")
def negative_count(spark: SparkSession, d: str) -> DataFrame:
    """The number of negative pairs without making them."""
    return evaluate.negative_count(_gold(spark, d), "cluster_id", "name")


@query(f"WITH {_GOLD} SELECT count(*) AS n, min(a) AS first_a, max(b) AS last_b FROM gn")
def negative_pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.negative_pairs(_gold(spark, d), "cluster_id", "name").agg(F.count("*").alias("n"), F.min("a").alias("first_a"), F.max("b").alias("last_b"))


_CM = "cm AS (SELECT count(CASE WHEN g = 1 AND h THEN 1 END) AS tp, count(CASE WHEN g = 1 AND NOT h THEN 1 END) AS fn, count(CASE WHEN g = 0 AND h THEN 1 END) AS fp, count(CASE WHEN g = 0 AND NOT h THEN 1 END) AS tn FROM (SELECT z.a, z.b, g, p.a IS NOT NULL AS h FROM (SELECT a, b, 1 AS g FROM gp UNION ALL SELECT a, b, 0 FROM gn) z LEFT JOIN p ON p.a = z.a AND p.b = z.b))"


@query(f"""WITH {_GOLD}, {_PRED}, {_CM}, r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS rc FROM cm)
SELECT tp, fn, fp, tn, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1_score, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy,
round(fp / (fp + tn), 6) AS fpr, round(tn / (tn + fp), 6) AS specificity FROM r""")
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How well the first word of a name tells the gold clusters."""
    g = _gold(spark, d)
    pred = evaluate.positive_pairs(g.withColumn("t", F.split("name", " ")[0]), "t", "name")
    return evaluate.metrics(evaluate.confusion_closed(g, "cluster_id", "name", pred))


@query("""SELECT i AS threshold_pct, m AS models, v AS voting FROM range(5, 31, 5) t(i), (SELECT b AS m FROM range(0, 64) u(b) WHERE bit_count(CAST(b AS INTEGER)) >= 3) s, (SELECT unnest(['all', 'majority', 'any']) AS v) w""")
def grid_combos(spark: SparkSession, d: str) -> DataFrame:
    """Every setting of thresholds, model subsets (as bits) and votings: 6 x 42 x 3."""
    names = [f"m{i}" for i in range(6)]
    subsets = [sum(1 << names.index(m) for m in s) for s in evaluate.model_subsets(names, 3)]
    return evaluate.grid(spark, threshold_pct=[5, 10, 15, 20, 25, 30], models=subsets, voting=list(voting.MODES))


_SWEEP = f"""{_PAIRS}, gp AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id), gn AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label <> b.label AND a.vec_id < b.vec_id),
z AS (SELECT a, b, 1 AS g FROM gp UNION ALL SELECT a, b, 0 FROM gn), y AS (SELECT z.*, s.s, t.threshold FROM z LEFT JOIN s ON s.i = z.a AND s.j = z.b CROSS JOIN (SELECT unnest([0.6, 0.65, 0.7]) AS threshold) t)"""


@query(f"""WITH {_SWEEP} SELECT CAST(threshold AS DOUBLE) AS threshold, count(CASE WHEN g = 1 AND s >= 1 - threshold THEN 1 END) AS tp, count(CASE WHEN g = 0 AND s >= 1 - threshold THEN 1 END) AS fp,
count(*) AS pairs FROM y GROUP BY 1""")
def grid_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """All thresholds in one pass over the same edges; the labels of the fixed embeddings sample are the gold."""
    e = _embeddings(spark, d).select("vec_id", "label")
    m = evaluate.label_sweep(_pairs(spark, d).select(F.col("i").alias("a"), F.col("j").alias("b"), "s"), e, "vec_id", "label", [0.6, 0.65, 0.7])
    return m.select("threshold", "tp", "fp", (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("pairs"))


_GRID_T = (0.55, 0.6, 0.65, 0.7, 0.75, 0.8)
_SIX = [(1 + 10 * i, 10) for i in range(6)]
_LGRID = f"""{_E}, w AS (SELECT a.label = b.label AS g, [{", ".join(f"list_cosine_similarity(a.v[{s}:{s + n - 1}], b.v[{s}:{s + n - 1}])" for s, n in _SIX)}] AS s FROM e a JOIN e b ON a.label // 4 = b.label // 4 AND a.vec_id < b.vec_id),
t AS (SELECT unnest([{", ".join(map(str, _GRID_T))}]) AS threshold), m AS (SELECT b AS models FROM range(0, 64) u(b) WHERE bit_count(CAST(b AS INTEGER)) >= 3), q AS (SELECT g, t.threshold, list_sum([CASE WHEN s[i] >= 1 - CAST(t.threshold AS DOUBLE) THEN CAST(1 << (i - 1) AS INTEGER) ELSE 0 END for i in [1, 2, 3, 4, 5, 6]]) AS bits, count(*) AS n FROM w, t GROUP BY ALL),
y AS (SELECT threshold, models, g, n, bit_count(CAST(bits AS INTEGER) & CAST(models AS INTEGER)) AS agree, bit_count(CAST(models AS INTEGER)) AS k FROM q, m),
z AS (SELECT threshold, models, v.voting, g, n, CASE v.voting WHEN 'all' THEN agree = k WHEN 'majority' THEN agree * 2 > k ELSE agree > 0 END AS h FROM y, (SELECT unnest(['all', 'majority', 'any']) AS voting) v)"""


@query(f"""WITH {_LGRID} SELECT CAST(threshold AS DOUBLE) AS threshold, models, voting, CAST(coalesce(sum(n) FILTER (g AND h), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (g AND NOT h), 0) AS BIGINT) AS fn,
CAST(coalesce(sum(n) FILTER (NOT g AND h), 0) AS BIGINT) AS fp, CAST(coalesce(sum(n) FILTER (NOT g AND NOT h), 0) AS BIGINT) AS tn FROM z GROUP BY 1, 2, 3""")
def link_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 756 settings of thresholds, subsets of six models and votings over the pairs within groups of labels."""
    e = _embeddings(spark, d).withColumn("block", F.expr("label div 4"))
    names = [f"m{i}" for i in range(6)]
    units = [vectors.normalize(F.slice("embedding", s, n)).alias(m) for m, (s, n) in zip(names, _SIX)]
    a = e.select("block", "vec_id", "label", *units)
    b = a.select("block", F.col("vec_id").alias("o"), F.col("label").alias("lo"), *[F.col(m).alias(f"o{m}") for m in names])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, "block").where("vec_id < o").select((F.col("label") == F.col("lo")).alias("gold"), *[dot(m, f"o{m}").alias(m) for m in names])
    g = evaluate.link_grid(pairs, names, "gold", list(_GRID_T))
    bits = F.expr("aggregate(models, 0L, (s, m) -> s + shiftleft(1L, int(substring(m, 2, 1))))")
    return g.select("threshold", bits.alias("models"), "voting", "tp", "fn", "fp", "tn")


_TF = r"""k AS (SELECT doc_kind AS topic, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents WHERE doc_kind IS NOT NULL), tf AS (SELECT topic, term, count(*) AS tf FROM k WHERE term <> '' GROUP BY 1, 2),
f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1), a AS (SELECT sum(tf) / count(DISTINCT topic) AS a FROM tf)"""


@query(f"WITH {_TF} SELECT topic, term, tf, round(tf * ln(1 + a / f), 6) AS ctfidf FROM tf JOIN f USING (term), a")
def ctfidf_topics(spark: SparkSession, d: str) -> DataFrame:
    w = topics.class_tfidf(table(spark, d, "documents", "doc_kind", "text"), "doc_kind", "text")
    return w.select("topic", "term", "tf", F.round("ctfidf", 6).alias("ctfidf"))


@query(f"WITH {_TF} SELECT topic, term, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(tf * ln(1 + a / f), 9) DESC, term) AS INTEGER) AS rank FROM tf JOIN f USING (term), a QUALIFY rank <= 10")
def topic_words(spark: SparkSession, d: str) -> DataFrame:
    w = topics.class_tfidf(table(spark, d, "documents", "doc_kind", "text"), "doc_kind", "text")
    return topics.top_terms(w, 10).select("topic", "term", "rank")


_CENT = f"""{_E}, o AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS topic FROM e), d AS (SELECT topic, unnest(v) AS x, unnest(range(64)) AS p FROM o WHERE topic >= 0),
m AS (SELECT topic, p, avg(x) AS x FROM d GROUP BY 1, 2), c AS (SELECT topic, list(x ORDER BY p) AS c FROM m GROUP BY 1)"""


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return _embeddings(spark, d).withColumn("topic", F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")))


@query(f"""WITH {_CENT}, n AS (SELECT o.vec_id, c.topic FROM o CROSS JOIN c WHERE o.topic = -1 QUALIFY row_number() OVER (PARTITION BY o.vec_id ORDER BY round(list_cosine_similarity(o.v, c.c), 9) DESC, c.topic) = 1)
SELECT o.vec_id, coalesce(n.topic, o.topic) AS topic FROM o LEFT JOIN n USING (vec_id)""")
def topic_centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    return topics.reduce_outliers(_topics(spark, d), "vec_id", "topic", "embedding")


@query(f"""WITH {_CENT} SELECT o.topic, o.vec_id, CAST(row_number() OVER (PARTITION BY o.topic ORDER BY round(list_cosine_similarity(o.v, c.c), 9) DESC, o.vec_id) AS INTEGER) AS rank FROM o JOIN c USING (topic) QUALIFY rank <= 3""")
def representative_docs(spark: SparkSession, d: str) -> DataFrame:
    return topics.representative_docs(_topics(spark, d), "vec_id", "topic", "embedding").select("topic", "vec_id", "rank")


@query("""WITH t AS (SELECT label // 2 AS parent, label, vec_id FROM embeddings) SELECT parent, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS topics, count(*) AS sentence_count, min(vec_id) AS first_sentence FROM t GROUP BY 1""")
def topic_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of parent topics, flattened from their leaves."""
    leaf = _embeddings(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    up = leaf.groupBy(F.expr("label div 2").cast("int").alias("parent")).agg(F.sort_array(F.collect_list(F.col("label").cast("string"))).alias("t"), F.sum("n").alias("sentence_count"), F.min("first").alias("first_sentence"))
    return up.select("parent", F.array_join("t", ",").alias("topics"), "sentence_count", "first_sentence")


@query()
def topic_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "text").where("source is not null")
    src = docs.select("source").distinct().withColumn("topic", F.dense_rank().over(Window.orderBy("source")).cast("int"))
    d2 = docs.join(src, "source")
    return topics.topic_hierarchy(topics.class_tfidf(d2, "topic", "text"), d2, "topic", "doc_id").select("Parent_ID", "left", "right", F.round("distance", 6).alias("distance"), "Topics", "sentence_count")


@query()
def density_topics(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters of the reduced embeddings; -1 marks outliers."""
    low = topics.reduce_dims(_embeddings(spark, d), "vec_id", "embedding", 5)
    return topics.density_clusters(low, "vec_id", "embedding", min_cluster_size=5, min_samples=3)


@query()
def link_entities(spark: SparkSession, d: str) -> DataFrame:
    """Stakeholder names linked with the reference items by two voting models, clustered, and named."""
    from ..operators.linking import LinkConfig, link_entities as link
    from .pipeline import anchor_table

    occ = table(spark, d, "positions", "position_id", "stakeholder").select(F.col("position_id").alias("ord"), normalize_text("stakeholder").alias("name")).where("name <> ''")
    a = anchor_table(table(spark, d, "df_max_views", "row_id", "normalized_anchor_text", "target_item_id", "target_page_id", "target_page_views"))
    return link(occ, a, table(spark, d, "kb_items"), LinkConfig(threshold=0.3, voting="all"))["names"].select("name", "cnt", "item_id", "final", "source")


@query()
def cleaned_positions(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning pipeline over the reports."""
    from .pipeline import post_process

    r = table(spark, d, "reports", "report_key", "id", "title", "political_issue", "positions")
    a = table(spark, d, "df_max_views", "row_id", "normalized_anchor_text", "target_item_id", "target_page_id", "target_page_views")
    c = post_process(r, a, table(spark, d, "kb_items"))["cleaned"]
    return c.select("report_key", "pos_no", "stakeholder", "position", "country_code", F.to_json("targets").alias("targets"))


@query(r"""WITH p AS (SELECT id, coalesce(author, 'Journalist') || ' of ' || source AS author, 'title: ####' || coalesce(title, '') || '####' || chr(10) || 'summary: ####' || coalesce(summary, '') || '####' || chr(10) || 'body: ####' || coalesce(body, '') || '####' AS t FROM articles)
SELECT id, author, true AS is_about_event, CAST(len(regexp_extract_all(t, '[A-Z][^.!?\n]{2,}? (?:rejected|criticised|praised|defended|demanded|questioned|endorsed) [^.!?\n]{3,}')) AS INTEGER) AS positions FROM p
WHERE len(regexp_extract_all(t, '[A-Z][^.!?\n]{2,}? (?:rejected|criticised|praised|defended|demanded|questioned|endorsed) [^.!?\n]{3,}')) > 0""")
def extracted_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports from articles by the offline extractor."""
    from ..operators.extract import reports_from_articles

    r = reports_from_articles(table(spark, d, "articles", "id", "title", "author", "source", "summary", "body", "@timestamp"))
    return r.select("id", "author", "is_about_event", F.size("positions").alias("positions"))


@query()
def reranked_terms(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of the kinds of documents by maximal marginal relevance over hashed term vectors."""
    w = topics.class_tfidf(table(spark, d, "documents", "doc_kind", "text"), "doc_kind", "text")
    return topics.rerank_terms(w, vectors.hashed_embedding(64), 10, 30, 0.3)


@query()
def topic_grid(spark: SparkSession, d: str) -> DataFrame:
    """Outliers and topics at several settings of all four parameters."""
    settings = [{"n_neighbors": n, "n_components": c, "min_cluster_size": s, "min_samples": m} for n in (10, 15) for c in (5,) for s in (5, 8) for m in (3,)]
    return topics.topic_grid(spark, _embeddings(spark, d), "vec_id", "embedding", settings)
