import numpy as np
import pytest

from stancelake.llm import vector_neighbours as vn


def frame(spark, x, model="m"):
    return spark.createDataFrame([(model, int(i), None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], "model string, id long, vec array<float>")


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1)[:, :k]


def blobs(seed, n=600, dim=24):
    r = np.random.default_rng(seed)
    c = r.standard_normal((n // 8, dim))
    return (c[r.integers(0, len(c), n)] + 0.25 * r.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("part_rows,splits", [(131_072, False), (100, False), (40, True)])
def test_recall(spark, part_rows, splits):
    x = blobs(1)
    s, top = exact(x.astype(float), 5)
    got = vn.nearest(frame(spark, x), 5, min_similarity=0.8, probes=32, cell_rows=16, part_rows=part_rows).collect()
    found = {(r.id, r.other) for r in got}
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.8}
    assert len(found & want) >= 0.9 * len(want)
    assert all(abs(r.similarity - s[r.id, r.other]) < 1e-5 and r.similarity >= 0.8 and r.id != r.other for r in got)
    assert max(r["rank"] for r in got) <= 5


def test_recall_holds_as_coordinates_are_added(spark):
    x = blobs(1)
    s, top = exact(x.astype(float), 5)
    want = {(i, int(j)) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.85}
    for bits in (10, 16):
        got = vn.nearest(frame(spark, x), 5, min_similarity=0.85, part_rows=1 << 40, total=64 << bits)
        assert len({(r.id, r.other) for r in got.collect()} & want) >= 0.93 * len(want)


def test_all_probes_are_exact(spark):
    x = blobs(2, 120, 8)
    s, top = exact(x.astype(float), 3)
    got = {}
    for r in vn.nearest(frame(spark, x), 3, probes=10_000, cell_rows=40).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    hit = sum(len({o for _, o in got[i]} & set(map(int, top[i]))) for i in range(len(x)))
    assert hit >= 0.97 * 3 * len(x)


def test_queries_by_modulus(spark):
    got = vn.nearest(frame(spark, blobs(3, 100, 8)), 2, probes=200, cell_rows=50, query_modulus=10).select("id").distinct().collect()
    assert {r.id for r in got} == set(range(0, 100, 10))


def test_cases(spark):
    x = [[1.0, 0.0]] * 30 + [None, [], [0.0, 0.0], [float("nan"), 1.0], [1.0, 0.0, 0.0], [0.99, 0.1]]
    df = frame(spark, x).selectExpr("*", "1 as part", "'x' as similarity")
    got = vn.nearest(df, 5, min_similarity=0.85, probes=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.other)
    assert set(by) == {*range(30), 35} and all(len(v) == 5 and i not in v for i, v in by.items())
    assert vn.nearest(df.where("false"), 5).count() == 0


def test_models_do_not_meet(spark):
    df = frame(spark, blobs(4, 40, 6)).unionByName(frame(spark, blobs(4, 40, 6), "n"))
    r = vn.nearest(df, 3, probes=500, cell_rows=40).groupBy("model", "id").count().collect()
    assert len(r) == 80 and {x["count"] for x in r} == {3}
