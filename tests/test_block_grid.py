import zlib

import numpy as np
from pyspark.sql import functions as F

from stancelake.operators import clustering, linking, vectors
from stancelake.operators.vectors import hashed_embedding, knn, similarity_pairs


def test_scattered_rows_meet_in_a_grid_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    r = np.random.default_rng(5)
    x = r.standard_normal((300, 24))
    x[100:130] = 3 * x[:30]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pairs = similarity_pairs(df, "id", "v", 0.4)
    assert "FlatMapGroupsInArrow" in pairs._jdf.queryExecution().toString()  # by pivots every row would visit every cell
    u = x / np.linalg.norm(x, axis=1)[:, None]
    i, j = np.nonzero(np.triu(u @ u.T, 1) >= 0.4)
    got = {(p.i, p.j): p.s for p in pairs.collect()}
    assert set(got) == set(zip(i.tolist(), j.tolist()))
    assert all(abs(got[a, b] - u[a] @ u[b]) < 1e-12 for a, b in got)


def test_clustered_texts_write_no_table_of_pairs(spark, monkeypatch):
    texts = [f"the council must repair bridge number {i:03d} of the {w} valley" for i in range(60) for w in ("upper", "lower", "old")] + ["", "other"]
    df = spark.createDataFrame([(t,) for i, t in enumerate(texts) for _ in range(i % 3 + 1)] + [(None,)], "t string")
    rows = {}

    def counted(f):
        def run(frame, name):
            out = f(frame, name)
            rows[name] = out.count()
            return out
        return run

    for m in (linking, clustering):
        monkeypatch.setattr(m, "materialize", counted(m.materialize))
    for t in (0.05, 0.2):
        got = {r.item: r.canonical for r in linking.cluster_texts(df, "t", t, hashed_embedding(48), "fast").collect()}
        assert max(rows.values()) <= len(texts)
        e = vectors.hashed_embedding(48)
        v = spark.createDataFrame([(x, e([x or "<PAD>"])[0].tolist(), i % 3 + 1) for i, x in enumerate(texts)], "i string, v array<float>, w long")
        want = clustering.threshold_communities(v.select("i", "w"), similarity_pairs(v, "i", "v", 1.0 - t).withColumn("s", F.least("s", F.lit(1.0))), "w")
        assert got == {r.item: r.canonical for r in want.collect()}
        assert 1 < len(set(got.values())) < len(texts)


def test_communities_do_not_depend_on_the_blocks(spark, monkeypatch):
    r = np.random.default_rng(6)
    base = r.standard_normal((25, 6))
    x = np.concatenate([base[r.integers(0, 25, 260)] + 0.5 * r.standard_normal((260, 6)), np.zeros((1, 6))])
    df = spark.createDataFrame([(i, int(i % 4 + 1), v.tolist()) for i, v in enumerate(x)], "i long, w long, v array<double>")
    want = clustering.threshold_communities(df.select("i", "w"), similarity_pairs(df, "i", "v", 0.7), "w")
    want = {tuple(a) for a in want.select("item", "center", "canonical").collect()}
    assert any(c != k for _, c, k in want)  # a centre that belongs to a larger one
    for cells in (10_000, 40):
        monkeypatch.setattr(vectors, "CELL_ROWS", cells)
        got = [tuple(a) for a in clustering.vector_communities(df, 1.0 - 0.7).collect()]
        assert len(got) == len(x) and set(got) == want


def test_lists_may_end_at_the_least_score(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, v array<float>")
    q = df.where("c % 7 = 0").withColumnRenamed("c", "q")
    for block in (1_000, 60):
        whole = {(a.q, a.c, a["rank"]) for a in knn(q, df, 5, "q", "c", "v", block_rows=block).collect() if a.score >= 0.97}
        assert whole == {(a.q, a.c, a["rank"]) for a in knn(q, df, 5, "q", "c", "v", block_rows=block, min_score=0.97).collect()}


def test_no_row_reaches_the_least_score(spark):
    df = spark.createDataFrame([("m", "a", [1.0, 0.0]), ("m", "b", [0.0, 1.0])], "model string, c string, v array<float>")
    q = spark.createDataFrame([("m", "x", [1.0, 1.0])], "model string, q string, v array<float>")
    assert knn(q, df, 5, "q", "c", "v", by=["model"], min_score=0.9).count() == 0
    assert [r.c for r in knn(q, df, 5, "q", "c", "v", by=["model"], min_score=0.7).orderBy("rank").collect()] == ["a", "b"]


def test_remembered_ngrams_change_no_vector():
    def plain(t, dim, ngram, seed):
        out, s = np.zeros(dim, np.float32), f"  {t.lower()} "
        for n in (ngram - 1, ngram, ngram + 1):
            for i in range(len(s) - n + 1):
                h = zlib.crc32(f"{seed}|{s[i : i + n]}".encode())
                out[(h >> 1) % dim] += 1.0 if h & 1 else -1.0
        return out

    for args in ((96, 3, 1), (64, 4, 2), (7, 3, 0)):
        texts = ["", "a", "Ünïcode – Ωmega", "the same same same words", "THE SAME"]
        assert np.array_equal(hashed_embedding(*args)(texts), np.stack([plain(t, *args) for t in texts]))
