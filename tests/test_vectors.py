import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.operators import vectors
from stancelake.operators.voting import elect, votes


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], "id long, v array<float>")


def brute(x, t):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] >= t}


@pytest.mark.parametrize("cell_rows", [10_000, 20])
@pytest.mark.parametrize("t", [0.2, 0.6, 0.9])
def test_similarity_pairs_is_exact(spark, monkeypatch, cell_rows, t):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((90, 6)), np.repeat(r.standard_normal((3, 6)), 12, axis=0) + 0.05 * r.standard_normal((36, 6))]).astype(np.float32)
    got = [(a.i, a.j) for a in vectors.similarity_pairs(frame(spark, x), "id", "v", t).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(x.astype(float), t)


def test_pairs_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, 0.0, 0.0])], "id long, v array<float>")
    assert [(r.i, r.j) for r in vectors.similarity_pairs(df, "id", "v", 0.5).collect()] == [(1, 2)]
    assert vectors.similarity_pairs(df.where("false"), "id", "v", 0.5).count() == 0


@pytest.mark.parametrize("block", [1_000, 17])
def test_knn_equals_sorting(spark, block):
    r = np.random.default_rng(2)
    x = r.standard_normal((80, 5)).astype(np.float32)
    c = frame(spark, x).withColumnRenamed("id", "c")
    q = frame(spark, x).where("id % 4 = 0").withColumnRenamed("id", "q")
    got = {(a.q, a.rank): a.c for a in vectors.knn(q, c, 3, "q", "c", "v", block_rows=block, exclude_self=True).collect()}
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    for i in range(0, 80, 4):
        s = u[i] @ u.T
        s[i] = -9
        want = sorted(range(80), key=lambda j: (-s[j], j))[:3]
        assert [got[(i, k + 1)] for k in range(3)] == want


def test_knn_ties_and_empties(spark):
    c = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (9, None)], "c long, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "q long, v array<float>")
    assert [(r.q, r.c, r["rank"]) for r in vectors.knn(q, c, 2, "q", "c", "v").orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert vectors.knn(q, c.where("false"), 2, "q", "c", "v").count() == 0


def test_joint_models_mean_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [3.0, 4.0]), (2, [1.0, 1.0], [4.0, 3.0])], "id long, a array<double>, b array<double>")
    j = df.select("id", vectors.joint_models(["a", "b"]).alias("v"))
    s = vectors.similarity_pairs(j, "id", "v", -1.0).first().s
    assert abs(s - (2**-0.5 + 0.96) / 2) < 1e-9


def test_embedding_is_deterministic_and_prefixed(spark):
    df = spark.createDataFrame([("a",), (None,), ("",)], "t string")
    m = {"x": vectors.hashed_embedding(8), "y": vectors.hashed_embedding(8, seed=1)}
    rows = vectors.embed(df, "t", m, prefixes={"y": "q: "}).collect()
    assert len(rows) == 6 and {len(r.embedding) for r in rows} == {8}
    assert len({tuple(r.embedding) for r in rows if r.model == "x"}) == 2  # null and empty are the same


def test_voting_rules(spark):
    m = spark.createDataFrame([
        ("q", "a", 0, 1, 0.9), ("q", "a", 1, 2, 0.7), ("q", "b", 0, 2, 0.8), ("q", "b", 1, 1, 0.85), ("q", "b", 2, 1, 0.81), ("q", "c", 2, 3, 0.95),
    ], "q string, c string, model_rank int, rank int, score double")
    v = votes(m, "q", "c", 5)
    win = lambda mode, t: [r.c for r in elect(v, "q", "c", 3, t, mode).collect()]
    assert win("all", 0.2) == ["b"]
    assert win("majority", 0.3) == ["a"]
    assert win("any", 0.1) == ["c"]
    assert win("all", 0.05) == []
    with pytest.raises(ValueError):
        win("some", 0.1)


def test_threshold_is_inclusive(spark):
    m = spark.createDataFrame([("q", "a", 0, 1, 0.7)], "q string, c string, model_rank int, rank int, score double")
    assert elect(votes(m, "q", "c", 5), "q", "c", 1, 0.3, "any").count() == 1


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r.n for r in df.select(vectors.normalize("v").alias("n")).collect()] == [[0.6, 0.8], None, None]
    assert df.limit(1).select(F.round(vectors.cosine("v", "v"), 9).alias("c")).first().c == 1.0


def test_knn_visits_only_cells_in_reach_and_stays_exact(spark):
    r = np.random.default_rng(5)
    centre = r.standard_normal((6, 8)) * 4
    rows = []
    for m in ("a", "b"):
        x = centre[r.integers(0, 6, 150)] + 0.3 * r.standard_normal((150, 8))
        x[:20] = x[0]  # copies of one vector
        rows += [(m, i, [float(v) for v in y], "clash") for i, y in enumerate(x)]
    rows += [("a", 900, [1.0, 2.0], "short"), ("a", 901, [2.0, 1.0], "short"), ("a", 902, None, "none"), ("b", 903, [0.0] * 8, "zero")]
    c = spark.createDataFrame(rows, "model string, c long, v array<double>, score string")
    q = c.withColumnRenamed("c", "q")
    for least in (None, 0.95):
        got = {}
        for x in vectors.knn(q, c, 4, "q", "c", "v", by=["model"], block_rows=40, exclude_self=True, min_score=least).collect():
            got.setdefault((x.model, x.q), []).append((x["rank"], x.c))
        for m, i, v, _ in rows:
            if v is None or not any(v):
                assert (m, i) not in got
                continue
            u = np.asarray(v) / np.linalg.norm(v)
            s = [(-round(float(u @ np.asarray(w) / np.linalg.norm(w)), 12), j) for n, j, w, _ in rows if n == m and j != i and w is not None and any(w) and len(w) == len(v)]
            want = [j for t, j in sorted(s) if least is None or -t >= least][:4]
            mine = [j for _, j in sorted(got.get((m, i), []))]
            # rounding in the last place may order equally similar copies either way
            near = dict((j, t) for t, j in s)
            assert len(mine) == len(want) and all(abs(near[a] - near[b]) < 1e-9 for a, b in zip(mine, want))
