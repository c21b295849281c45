import numpy as np
import pytest

from stancelake.operators.clustering import cluster, complete_linkage, conflicting, propagate, replace_by_canonical, threshold_communities
from stancelake.operators.graph import connected_components


def greedy(n, s, t, w=None, min_size=1):
    """The peeling of communities, straight from its description."""
    com = []
    for i in range(n):
        m = [j for j in range(n) if s[i, j] >= t]
        if len(m) >= min_size:
            com.append((i, sorted(m, key=lambda j: (-s[i, j], j))))
    com.sort(key=lambda c: (-sum(1 if w is None else w[j] for j in c[1]), c[0]))
    taken, out = set(), {}
    for i, m in com:
        left = [j for j in m if j not in taken]
        if len(left) >= min_size:
            taken.update(left)
            out.update({j: (i, left[0]) for j in left})
    return out


def frames(spark, s, t, w=None):
    n = len(s)
    items = spark.createDataFrame([(i, 1 if w is None else int(w[i])) for i in range(n)], "i long, w long")
    pairs = spark.createDataFrame([(i, j, float(s[i, j])) for i in range(n) for j in range(i + 1, n) if s[i, j] >= t], "i long, j long, s double")
    return items, pairs


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("weighted", [False, True])
def test_closed_form_equals_greedy(spark, seed, weighted):
    r = np.random.default_rng(seed)
    n = 30
    s = np.round(r.random((n, n)), 3)
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1)
    w = r.integers(1, 5, n) if weighted else None
    items, pairs = frames(spark, s, 0.6, w)
    got = {x.item: (x.center, x.canonical) for x in threshold_communities(items, pairs, "w" if weighted else None).collect()}
    assert got == greedy(n, s, 0.6, w)


def test_larger_min_size_peels(spark):
    r = np.random.default_rng(5)
    s = np.round(r.random((25, 25)), 3)
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1)
    items, pairs = frames(spark, s, 0.65)
    got = {x.item: (x.center, x.canonical) for x in threshold_communities(items, pairs, min_size=3).collect()}
    assert got == greedy(25, s, 0.65, min_size=3)


def test_hand_checked(spark):
    e = [("a", "b", .9), ("a", "c", .9), ("c", "d", .9)]
    items = spark.createDataFrame([(x,) for x in "abcdef"], "i string")
    got = {x.item: x.canonical for x in threshold_communities(items, spark.createDataFrame(e, "i string, j string, s double")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}


def test_complete_linkage_invariant(spark):
    r = np.random.default_rng(3)
    x = r.random((40, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    items, pairs = frames(spark, 1 - d, 0.6)
    got = {}
    for m in complete_linkage(items, pairs, 0.4).collect():
        got.setdefault(m.center, []).append(m.item)
    assert sorted(i for g in got.values() for i in g) == list(range(40))
    for c, g in got.items():
        assert c == min(g) and max(d[i, j] for i in g for j in g) < 0.4
    groups = list(got.values())
    for a in range(len(groups)):  # no two clusters could still be merged
        for b in range(a):
            assert max(d[i, j] for i in groups[a] for j in groups[b]) >= 0.4


def test_methods(spark):
    items, pairs = frames(spark, np.eye(3), 0.5)
    assert cluster(items, pairs, 0.3, "agglomerative").count() == 3
    with pytest.raises(ValueError):
        cluster(items, pairs, 0.3, "slow")


def test_components(spark):
    n = 200
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()))
    assert all(got[i] == 0 for i in range(n + 1)) and got[1000] == got[1001] == 1000
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_propagation(spark):
    m = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "x", 3), ("d", "y", 1)], "item string, center string, rank int")
    lab = spark.createDataFrame([("b", 7), ("c", 9)], "item string, label int")
    got = {r.item: (r.label, r.source) for r in propagate(m, lab).collect()}
    assert got == {"a": (7, "cluster"), "b": (7, "own"), "c": (9, "own"), "d": (None, None)}
    assert [(r.center, r.labels) for r in conflicting(m, lab).collect()] == [("x", [7, 9])]


def test_replacement(spark):
    df = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (3, None, "k")], "id long, name string, item string")
    mp = spark.createDataFrame([("a", "A")], "item string, canonical string")
    assert sorted((r.id, r.name, r["item"]) for r in replace_by_canonical(df, "name", mp).collect()) == [(1, "A", "k"), (2, "b", "k"), (3, None, "k")]
