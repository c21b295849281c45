import random

import pytest

from stancelake.llm import leakage
from stancelake.llm.text import words


def brute(docs, items, m):
    out = set()
    for d, t in docs:
        w = words(t)
        runs = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}
        for i, *fields in items:
            for f in fields:
                v = words(f)
                if any(tuple(v[k : k + m]) in runs for k in range(len(v) - m + 1)):
                    out.add((d, i))
    return out


@pytest.mark.parametrize("block", [500_000, 40])
def test_equals_brute_force(spark, vocabulary, block):
    r = random.Random(3)
    v = vocabulary[:12]
    items = [(i, " ".join(r.choice(v) for _ in range(20)), " ".join(r.choice(v) for _ in range(6))) for i in range(15)]
    docs = []
    for d in range(60):
        w = [r.choice(v) for _ in range(40)]
        if d % 2:
            p = items[r.randrange(15)][1].split()
            a = r.randrange(12)
            w[10:10] = [x.upper() + "," for x in p[a : a + r.randint(3, 12)]]
        docs.append((d, " ".join(w)))
    dd = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame(items, "item_id long, passage string, question string")
    got = leakage.leaks(dd, ii, "doc_id", "text", "item_id", ["passage", "question"], 4, block)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == brute(docs, items, 4)


def test_cases(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h", None), (2, "", "too short")], "item_id long, passage string, question string")
    docs = spark.createDataFrame([(1, "x A, b-c d <p>e f g h!"), (2, None), (3, ""), (4, "a b c d e f g"), (1, "x A, b-c d e f g h"), (5, "z " * 100_000 + "a b c d e f g h")], "doc_id long, text string")
    got = leakage.leaks(docs, items, "doc_id", "text", "item_id", ["passage", "question"])
    assert {(r.doc_id, r.item_id, r.windows) for r in got.collect()} == {(1, 1, 2), (5, 1, 1)}
    assert leakage.leaks(docs, items.where("false"), "doc_id", "text", "item_id", ["passage"]).count() == 0
    assert leakage.leaks(docs.where("false"), items, "doc_id", "text", "item_id", ["passage"]).count() == 0
