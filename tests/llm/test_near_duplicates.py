import itertools
import random
import re

import numpy as np
import pytest

from stancelake.llm import near_duplicates as nd


def shingles(t, run):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}


def brute(rows, run, t):
    s = [(i, shingles(x, run)) for i, x in rows]
    out = set()
    for (a, x), (b, y) in itertools.combinations(s, 2):
        if a != b and x and y and len(x & y) >= t * len(x | y) - 1e-12:
            out.add((min(a, b), max(a, b)))
    return out


def corpus(vocabulary, seed, n=120):
    r = random.Random(seed)
    common = vocabulary[:25]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, 8)):
                j = r.randrange(len(w))
                w[j : j + 1] = r.choice([[], [r.choice(vocabulary)], [w[j], r.choice(common)]])
            if r.random() < 0.3 and len(w) > 4:
                k = r.randrange(len(w))
                w = w[k:] + w[:k]
        else:
            w = [r.choice(common if r.random() < 0.6 else vocabulary) for _ in range(r.randint(5, 60))]
        rows.append((f"d{i:03d}", " ".join(w)))
    return rows


@pytest.mark.parametrize("run,t", [(3, 0.5), (2, 0.8), (5, 0.8)])
def test_pairs_equal_brute_force(spark, vocabulary, run, t):
    rows = corpus(vocabulary, run)
    df = spark.createDataFrame(rows, "id string, text string")
    m, k = nd.near_duplicates(df, "id", "text", run, t)
    got = {tuple(r) for r in nd.expand_pairs(m, k).collect()}
    assert got == brute(rows, run, t) and got


def test_split_lists_lose_nothing(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(nd, "LONG_LIST", 5)
    monkeypatch.setattr(nd, "GROUP_POSTINGS", 50)
    rows = corpus(vocabulary, 9)
    df = spark.createDataFrame(rows, "id string, text string")
    m, k = nd.near_duplicates(df, "id", "text", 3, 0.5)
    assert {tuple(r) for r in nd.expand_pairs(m, k).collect()} == brute(rows, 3, 0.5)


def test_cases(spark):
    long = " ".join(f"w{i}" for i in range(5_000))
    rows = [("a", "One two, THREE four"), ("b", "one two three four!"), ("c", None), ("d", ""), ("e", "one two"), ("f", long), ("g", long + " more"), ("a", "One two, THREE four"), (None, "one two three four")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id string, text string, key int, rep string")
    m, k = nd.near_duplicates(df, "id", "text", 3, 0.5)
    assert {tuple(r) for r in nd.expand_pairs(m, k).collect()} == {("a", "b"), ("f", "g")}
    g = {r.id: (r.group_id, r.links) for r in nd.duplicate_groups(m, k).collect()}
    assert g == {"a": ("a", 0), "b": ("a", 0), "f": ("f", 1), "g": ("f", 1)}
    m, k = nd.near_duplicates(df.where("false"), "id", "text")
    assert m.count() == k.count() == 0


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(r.integers(-(2**62), 2**62, 150))
        y = np.unique(np.concatenate([x[: r.integers(0, 150)], r.integers(-(2**62), 2**62, 60)]))
        far = int(np.bitwise_count(nd.bitmap(x, 1024) ^ nd.bitmap(y, 1024)).sum())
        assert far <= len(np.setxor1d(x, y))


def test_the_merge_meets_partners_of_fitting_sizes_only(monkeypatch):
    import collections
    import types

    import pyarrow as pa

    r = random.Random(3)
    phrases = [r.sample(range(10**6), 6) for _ in range(60)]  # shingles of phrases that all texts are made of
    sets = [sorted({x for p in r.sample(phrases, r.choice([10, 11, 12, 13])) for x in p} | set(r.sample(range(10**7, 2 * 10**7), 25))) for _ in range(600)]
    sets += [sorted(set(s[r.randrange(1, 20) :]) | {10**8 + i}) for i, s in enumerate(sets[:40])]
    df = collections.Counter(x for s in sets for x in s)
    known = np.array(sorted(x for x in df if df[x] > 2))
    lengths = np.array([df[x] for x in known.tolist()])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i:032x}" for i in range(len(sets))]), pa.array(sets, pa.list_(pa.int64()))], names=["key", "sh"])
    routed = pa.Table.from_batches(nd._router(types.SimpleNamespace(value=(known, lengths)), 0.5, 512, 1)([batch]))
    # pairs that meet anywhere in the short lists of both
    tok = np.frombuffer(routed["tok"][0].as_py(), np.int64)
    met = sum(k * (k - 1) // 2 for k in collections.Counter(tok.tolist()).values())
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: compared.append(x.size) or count(x))
    got = {(int(p["key_a"], 16), int(p["key_b"], 16)) for p in nd._merger(0.5)(routed).to_pylist() if p["c"] >= p["need"]}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(enumerate(map(set, sets)), 2) if 3 * len(x & y) >= len(x) + len(y)}
    assert want and want <= got
    assert sum(compared) / 8 < met / 3  # bitmaps of eight words
