import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.functions import text as X
from stancelake.operators import dedup, evaluate, extract, nested, reports, topics
from stancelake.schemas import ARTICLE, REPORT, vocabulary_violations, with_missing
from stancelake.sources import io


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_text(spark):
    assert one(spark, X.normalize_text("a"), a="\t Ab C \n") == "ab c"
    assert one(spark, X.author_label("a", "s"), a=None, s="News") == "Journalist of News"
    assert one(spark, X.author_label("a", "s"), a="Jo", s="News") == "Jo of News"
    assert one(spark, X.pad_empty("a"), a="") == "<PAD>"
    assert one(spark, X.augmented_entity("l", "d", "al"), l="La", d="x", al=["A", "b"]) == "la (x) | aliases: a, b"
    assert one(spark, X.augmented_entity("l", "d", "al"), l="La", d=None, al=[]) == "la ()"
    assert one(spark, X.strip_fences("a"), a="```json\n{}\n```") .strip() == "{}"
    assert one(spark, X.country_or_null("a"), a="none") is None and one(spark, X.country_or_null("a"), a=" ab") == "AB"
    assert [one(spark, X.is_true("a"), a=v) for v in ("True", "false", "x", None)] == [True, False, None, None]
    assert one(spark, X.user_prompt("##", title="a", body="b"), a="t", b=None) == "title: ##t##\nbody: ####"
    assert one(spark, X.instruct("a", "q: "), a="t") == "q: t" and one(spark, X.q_id("a"), a="5") == "Q5"


@pytest.mark.parametrize("s", ["2023-10-01T01:18:21Z", "2023-10-01 01:18:21", "1696123101000", "1696123101"])
def test_timestamps(spark, s):
    assert one(spark, F.unix_timestamp(X.any_timestamp("a")), a=s) == 1696123101


def test_odd_timestamps(spark):
    assert one(spark, X.any_timestamp("a"), a="01.03.2024 13:06") == datetime(2024, 3, 1, 13, 6)
    assert one(spark, X.any_timestamp("a"), a="soon") is None and one(spark, X.any_timestamp("a"), a=None) is None


REPORTS = [
    ("r1", [{"stakeholder": "a", "position": "p", "support": {"type": "t", "content": None}, "targets": [{"predicate": "x", "target": "y", "stance_type": "z"}, {"predicate": None, "target": "w", "stance_type": None}], "country": {"name": "N", "code": "n"}},
            {"stakeholder": "b", "targets": []}]),
    ("r2", []), ("r3", None)]


def test_explode_and_regroup_round_trip(spark):
    df = spark.createDataFrame([(k, p) for k, p in REPORTS], "id string, positions " + REPORT["positions"].dataType.simpleString())
    p = nested.explode_positions(df, ["id"])
    assert p.count() == 2 and nested.explode_positions(df, ["id"], outer=True).count() == 4
    assert {"support_type", "country_code", "pos_no"} <= set(p.columns)
    assert nested.with_members(p, "targets").count() == 1
    t = nested.explode_targets(p, ["id", "pos_no"])
    back = nested.regroup(t, ["id", "pos_no"], "target_no", ["predicate", "target", "stance_type"]).first()
    assert back.targets == nested.with_members(p, "targets").first().targets


def test_flatten_names_do_not_clash(spark):
    df = spark.sql("select 1 as a, 2 as s_a, named_struct('a', 3, 'b', named_struct('c', 4)) as s, array(5) as z")
    out = nested.flatten_struct(df, "s").first().asDict()
    assert out == {"a": 1, "s_a": 2, "z": [5], "a_2": 3, "b_c": 4}


def test_relevant(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_about_event boolean")
    assert [r.id for r in nested.relevant(df).collect()] == [1]
    assert nested.relevant(df.withColumn("is_about_politics", F.col("id") == 2)).first().id == 2
    assert nested.relevant(df.drop("is_about_event")).count() == 3


def test_survivors(spark):
    df = spark.createDataFrame([("k", 3, 5), ("k", 1, 7), ("k", 2, 7), (None, 9, None), (None, 8, None), ("m", 4, None)], "key string, id int, v long")
    assert sorted((r.key or "", r.id) for r in dedup.keep_first(df, ["key"], ["id"]).collect()) == [("", 8), ("k", 1), ("m", 4)]
    assert sorted((r.key or "", r.id) for r in dedup.best_per_key(df, ["key"], "v", "id").collect()) == [("", 8), ("k", 1), ("m", 4)]
    once = dedup.keep_first(df, ["key"], ["id"])
    assert sorted(map(str, dedup.keep_first(once, ["key"], ["id"]).collect())) == sorted(map(str, once.collect()))
    c = spark.createDataFrame([("g", "x", 2), ("g", "y", 1), ("g", "x", 3), ("g", "y", 4), ("g", None, 0)], "g string, i string, o int")
    assert [(r.i, r.n) for r in dedup.most_common(c, ["g"], "i", "o", 5).orderBy("rank").collect()] == [("y", 2), ("x", 2)]


def test_hash_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = dedup.hash_sample(df, "k", 50, 1), dedup.hash_sample(df.repartition(7), "k", 50, 1)
    assert {r.k for r in a.collect()} == {r.k for r in b.collect()} and dedup.hash_sample(df, "k", 50, 2).exceptAll(a).count() > 0


def test_metrics_by_hand(spark):
    g = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "d"), (1, "e")], "k int, n string")
    pos, neg = evaluate.positive_pairs(g, "k", "n"), evaluate.negative_pairs(g, "k", "n")
    pred = spark.createDataFrame([("b", "a"), ("d", "a"), ("d", "a")], "a string, b string")
    m = evaluate.metrics(evaluate.confusion(pos, neg, pred)).first()
    assert (m.tp, m.fn, m.fp, m.tn) == (1, 3, 1, 5)
    assert (m.precision, m.recall, m.f1_score, m.accuracy) == (0.5, 0.25, 0.333333, 0.6)
    z = evaluate.metrics(spark.createDataFrame([(0, 0, 0, 0)], "tp int, fn int, fp int, tn int")).first()
    assert z.precision == z.recall == z.f1_score == z.accuracy == 0


def test_grid_and_resume(spark):
    g = evaluate.grid(spark, t=[1, 2], m=[["a", "b"], ["c"]])
    done = spark.createDataFrame([(1, ["b", "a"], 0.5)], "t long, m array<string>, f double")
    left = io.pending(g, done, ["t", "m"])
    assert left.count() == 3 and io.pending(g, None, ["t"]).count() == 4
    assert len(evaluate.model_subsets(list("abcdef"), 3)) == 42


def test_gold_and_records(spark, tmp_path):
    (tmp_path / "gold.txt").write_text('[["a", "b"],\n  ["c"]]\n')
    assert [tuple(r) for r in io.read_gold(spark, str(tmp_path / "gold.txt")).orderBy("cluster_id", "ord").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    df = spark.createDataFrame([("1", "t")], "id string, title string")
    path = io.write_records(df, str(tmp_path), "m", "x", datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("m_x_report_20240102-030405")
    assert io.read_records(spark, path).first().title == "t"
    (tmp_path / "a.csv").write_text("normalized_anchor_text,target_item_id,target_page_id,target_page_views\nx,1,2,3\n,4,5,6\n")
    assert [r[0] for r in io.read_anchors(spark, str(tmp_path / "a.csv")).collect()] == ["x", None]


def test_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    p = str(tmp_path / "t")
    assert io.build_or_load(spark, p, build).count() == io.build_or_load(spark, p, build).count() == 3 and len(calls) == 1


def test_kb_record(spark):
    raw = json.dumps({"entities": {"Q1": {"labels": {"en": {"language": "en", "value": "Kyiv"}, "xx": {"language": "xx", "value": "no"}}, "descriptions": {"en": {"language": "en", "value": "Capital"}}, "aliases": {"en": [{"language": "en", "value": "Kiev"}]}}}})
    rows = {r.item_id: r for r in io.parse_kb(spark.createDataFrame([(1, raw), (2, "oops"), (3, None)], "item_id long, j string"), "item_id", "j").collect()}
    assert (rows[1].main_label, rows[1].labels, rows[1].description, rows[1].aliases, rows[1].en_aliases) == ("Kyiv", ["kyiv"], "capital", ["kiev"], ["kiev"])
    assert rows[2].main_label is None and rows[3].main_label is None


def test_periods_and_events(spark):
    e = io.events_table(spark, {"prompts": {"datasets": {"link_along_events": {"k": {"name": "n", "search_period": "01.02.2024-03.02.2024"}, "z": {"search_period": "x"}}}}})
    r = {x.key: x for x in io.search_period(e).collect()}
    assert str(r["k"].period_start) == "2024-02-01" and str(r["k"].period_end) == "2024-02-03" and r["z"].period_start is None


def test_vocabulary(spark):
    df = spark.createDataFrame([("Pro", None, "Social"), ("pro", "Positive", "x")], "stance string, sentiment string, context string")
    assert sorted((r.field, r.value, r.n) for r in vocabulary_violations(df).collect()) == [("context", "x", 1), ("stance", "pro", 1)]
    assert with_missing(df, ARTICLE).columns[:7] == ARTICLE.fieldNames()


def test_heatmap(spark):
    p = spark.createDataFrame([("ab", "p", "s", 1), ("AB", "q", "s", 2), ("AB", "q", "t", 3), ("None", "q", "t", 4), (None, "q", "t", 5)], "country_code string, position string, stakeholder string, o int")
    r = reports.country_heatmap(p, "o").collect()
    assert [tuple(x) for x in r] == [("AB", 3, 2, "q (2)<br>p (1)")]


def test_page_escapes():
    page = reports.render_summary('```json\n{"title": "a<b", "key_points": [{"point": "p", "explanation": "e"}], "important_stakeholders_per_country": {"X": [{"name": "n", "explanation": "m"}]}}\n```')
    assert "a&lt;b" in page and "<b>n</b>: m" in page


def test_extraction(spark):
    a = spark.createDataFrame([("1", "t", None, "News", None, "The council rejected the plan. Nothing more.", None), ("2", None, None, "News", None, None, None)], ARTICLE)
    r = extract.reports_from_articles(a).collect()
    assert len(r) == 1 and r[0].author == "Journalist of News" and r[0].positions[0].stance == "Con"

    def broken(prompt):
        raise OSError

    assert extract.reports_from_articles(a, broken).count() == 0 and extract.reports_from_articles(a, broken, keep_empty=True).count() == 2


def test_density_finds_blobs(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([c + 0.05 * r.standard_normal((30, 2)) for c in ([0, 0], [3, 0], [0, 3])] + [r.uniform(-6, 6, (6, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>")
    t = {a.id: a.topic for a in topics.density_clusters(df, "id", "v", 10, 4).collect()}
    for b in range(3):
        got = [t[i] for i in range(30 * b, 30 * b + 30)]
        main = max(set(got), key=got.count)
        assert main >= 0 and got.count(main) >= 27
    assert len({t[0], t[30], t[60]}) == 3


def test_outliers_and_representatives(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 1, [0.0, 1.0]), (4, -1, [0.1, 0.9])], "id long, topic int, v array<double>")
    assert {r.id: r.topic for r in topics.reduce_outliers(df, "id", "topic", "v").collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    assert topics.reduce_outliers(df.where("topic = -1"), "id", "topic", "v").first().topic == -1
    s = topics.outlier_stats(df, "topic").first()
    assert (s.outlier_count, float(s.outlier_percentage)) == (1, 25.0)


def test_hierarchy_and_words(spark):
    d = spark.createDataFrame([(1, 0, "cat dog"), (2, 1, "cat dog bird"), (3, 2, "stone river"), (4, None, "x")], "id long, t int, text string")
    w = topics.class_tfidf(d, "t", "text")
    h = topics.topic_hierarchy(w, d, "t", "id").orderBy("Parent_ID").collect()
    assert [(r.Parent_ID, r.Topics, r.sentence_count) for r in h] == [(3, [0, 1], 2), (4, [0, 1, 2], 3)]
    from stancelake.operators.vectors import hashed_embedding

    assert topics.rerank_terms(w, hashed_embedding(32), k=2).where("topic = 1").count() == 2


def test_reduced_dims_keep_variance(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((200, 2)) @ r.standard_normal((2, 8)) + 5
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, v array<double>")
    low = np.array([a.v for a in topics.reduce_dims(df, "id", "v", 2).orderBy("id").collect()])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert low.shape == (200, 2) and low.var(0).sum() > 0.9 * u.var(0).sum()


def test_grid_of_topics_resumes_and_reports_failure(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(30)], "id long, v array<double>")
    s = [{"n_components": 2, "min_cluster_size": 5, "min_samples": 3}, {"n_components": 2, "min_cluster_size": 5, "min_samples": "x"}]
    first = topics.topic_grid(spark, df, "id", "v", s[:1])
    both = topics.topic_grid(spark, df, "id", "v", s[:1], first)
    assert both.count() == 1 and first.first().outlier_count >= 0


def test_streaming_ingest(spark, tmp_path):
    from stancelake.streaming.ingest import ingest

    schema = "id string, received_at timestamp, positions " + REPORT["positions"].dataType.simpleString()
    pos = [{"stakeholder": " A ", "targets": [{"target": "x"}]}]
    src, sink, cp = (str(tmp_path / n) for n in ("src", "sink", "cp"))
    rows = [("1", datetime(2024, 1, 1), pos), ("1", datetime(2024, 1, 2), pos), ("2", datetime(2024, 1, 1), [])]
    spark.createDataFrame(rows, schema).write.parquet(src)
    ingest(spark, src, spark.read.parquet(src).schema, sink, cp)
    ingest(spark, src, spark.read.parquet(src).schema, sink, cp)
    got = spark.read.parquet(sink).collect()
    assert [(r.id, r.stakeholder) for r in got] == [("1", "a")]


def test_linking_and_pipeline(spark):
    from stancelake.operators.linking import LinkConfig, hit_rate, link_entities
    from stancelake.plans.pipeline import post_process

    anchors = spark.createDataFrame([(1, "volodymyr zelenskyy", 10, 100, 5), (2, "angela merkel", 20, 200, 7), (3, None, 30, 1, 1)], "row_id long, normalized_anchor_text string, target_item_id long, target_page_id long, target_page_views long")
    kb = spark.createDataFrame([(10, "Volodymyr Zelenskyy", ["volodymyr zelenskyy"], "president", ["zelensky"], ["zelensky"]), (20, "", ["angela merkel"], None, None, None)],
                               "item_id long, main_label string, labels array<string>, description string, aliases array<string>, en_aliases array<string>")
    occ = spark.createDataFrame([(1, "volodymyr zelenskyy"), (2, "angela merkel"), (3, "zelensky"), (4, "farmers"), (5, None)], "ord long, name string")
    out = link_entities(occ, anchors, kb, LinkConfig(threshold=0.3))
    n = {r.name: r for r in out["names"].collect()}
    assert n["volodymyr zelenskyy"].item_id == 10 and n["zelensky"].item_id == 10 and n["angela merkel"].item_id == 20 and n["farmers"].item_id is None
    assert n["zelensky"].final == "Volodymyr Zelenskyy" and n["angela merkel"].final == "angela merkel"
    assert hit_rate(out["names"]).first().linked == 3
    with pytest.raises(ValueError):
        LinkConfig(voting="none")
    mk = lambda s, p, code: {"stakeholder": s, "position": p, "targets": [{"predicate": "backs", "target": "Farmers", "stance_type": "Positive"}], "country": {"name": "X", "code": code}}
    rep = spark.createDataFrame([(1, [mk(" Zelensky", "send aid now", "ua"), {"stakeholder": "z", "targets": []}]), (2, [mk("zelensky", "send aid now", None)])], "report_key long, positions " + REPORT["positions"].dataType.simpleString())
    c = post_process(rep, anchors, kb)["cleaned"].collect()
    assert len(c) == 1 and c[0].country_code == "UA" and c[0].targets[0].target == "Farmers" and c[0].report_key == 1


def test_order_keys(spark):
    from stancelake.functions.text import order_key

    rows = [(-(2**63), 0), (-5, 7), (-5, 1_000), (0, 0), (3, 99_999), (3, 100_001), (10**18, 2)]
    df = spark.createDataFrame(rows, "a long, b int").withColumn("k", order_key("a", "b"))
    assert [(r.a, r.b) for r in df.orderBy("k").collect()] == rows and df.select("k").distinct().count() == len(rows)


def test_closed_form_negatives(spark):
    from stancelake.operators import evaluate as ev

    rows = [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d"), (3, "e"), (4, "e"), (4, "d"), (5, "f"), (5, "g")]
    df = spark.createDataFrame(rows, "k int, x string")
    assert ev.negative_count(df, "k", "x").first().n == ev.negative_pairs(df, "k", "x").count()
    pred = spark.createDataFrame([("a", "b"), ("c", "b"), ("g", "f"), ("a", "c"), ("e", "d"), ("f", "a"), ("a", "a")], "a string, b string")
    want = ev.confusion(ev.positive_pairs(df, "k", "x"), ev.negative_pairs(df, "k", "x"), pred).first()
    assert ev.confusion_closed(df, "k", "x", pred).first().asDict() == want.asDict()


def test_link_grid_equals_counting(spark):
    import random

    from stancelake.operators.evaluate import link_grid

    r = random.Random(1)
    rows = [(r.random() < 0.3, *[round(r.random(), 2) for _ in range(4)]) for _ in range(200)]
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0)], "gold boolean, m0 double, m1 double, m2 double, m3 double")
    got = {(x.threshold, tuple(x.models), x.voting): (x.tp, x.fn, x.fp, x.tn) for x in link_grid(df, ["m0", "m1", "m2", "m3"], "gold", [0.3, 0.6]).collect()}
    assert len(got) == 2 * 5 * 3
    for (t, ms, v), c in got.items():
        want = [0, 0, 0, 0]
        for g, *s in rows:
            yes = [s[int(m[1])] >= 1.0 - t for m in ms]
            hit = {"all": all(yes), "majority": sum(yes) * 2 > len(yes), "any": any(yes)}[v]
            want[(0 if hit else 1) if g else (2 if hit else 3)] += 1
        assert c == tuple(want)


def test_json_schema(spark):
    from stancelake.schemas import conforms, from_json_schema

    s = {"type": "object", "required": ["a"], "$defs": {"p": {"type": "object", "properties": {"n": {"type": ["null", "integer"]}}}}, "properties": {
        "a": {"type": "string", "enum": ["x", "y"]}, "b": {"type": "array", "items": {"$ref": "#/$defs/p"}}, "c": {"type": "object", "additionalProperties": {"type": "number"}}, "d": {"anyOf": [{"type": "boolean"}, {"type": "null"}]}}}
    t = from_json_schema(s)
    assert t.simpleString() == "struct<a:string,b:array<struct<n:bigint>>,c:map<string,double>,d:boolean>"
    rows = spark.createDataFrame([('{"a": "x"}',), ('{"a": "z"}',), ('{"b": []}',), ("no json",)], "j string").selectExpr(f"from_json(j, '{t.simpleString()}') as r")
    assert [x.ok for x in rows.select(conforms("r", s).alias("ok")).collect()] == [True, False, False, False]


def test_long_statements_are_kept():
    import json

    from stancelake.operators.extract import stub_extractor

    who, what = "The " + "very " * 40 + "old council", "the plan " * 60
    got = json.loads(stub_extractor(f"{who} rejected {what}."))["positions"][0]
    assert got["stakeholder"] == who and got["targets"][0]["target"] == what.strip()


def test_neighbours_by_a_score_of_ones_own(spark):
    import numpy as np

    from stancelake.operators.vectors import euclidean_score, knn, mean_pool

    x = np.random.default_rng(3).standard_normal((60, 5)) * 3
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "id long, v array<double>, k int")
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.eye(60) * 1e9
    got = knn(df.withColumnRenamed("id", "q"), df, 3, "q", "id", "v", block_rows=17, exclude_self=True, score=euclidean_score).collect()
    assert {(r.q, r.id) for r in got} == {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:3]}
    m = {r.k: r.embedding for r in mean_pool(df.withColumn("use", df.id > 7), ["k"], "v", mask="use").collect()}
    assert all(np.allclose(m[k], x[[i for i in range(8, 60) if i % 4 == k]].mean(0)) for k in range(4))
    assert mean_pool(df.where("false"), ["k"], "v").count() == 0
