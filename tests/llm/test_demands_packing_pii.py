import random

import numpy as np
import pytest

from stancelake.llm import packing, personal_data
from stancelake.llm.demand_clusters import clusters, describe
from stancelake.llm.personal_data import find_spans, form_spans, sanitise

ACTS = [("ban", "outlaw", "prohibit"), ("rename", "retitle", "give a new name to"), ("audit", "examine", "review")]
SYLLABLES = [c + v for c in "bdgklmnprstvz" for v in "aeiou"]


def words(r, n, end=""):
    return ["".join(r.choice(SYLLABLES) for _ in range(3)) + end for _ in range(n)]


def demands(seed=4, places=150):
    """Sentences of several shapes about a thing in a place; each demand has its helpers and its date."""
    r = random.Random(seed)
    things = [f"{a} {b}" for a, b in zip(words(r, 60), words(r, 60, "s"))]
    helped, dates = words(r, 60, "ers"), words(r, 60, "day")
    rows, truth = [], {}
    i = 0
    for k in range(places):
        place = "".join(r.choice(SYLLABLES) for _ in range(5)).capitalize() + "haven"
        act, thing, h, d = ACTS[k % 3], r.choice(things), r.choice(helped), r.choice(dates)
        for _ in range(r.choice([1, 2, 4, 6, 9])):
            a, who, by = r.choice(act), r.choice([f" to help {h}", f" for {h}", ""]), r.choice([f" by {d}", f" until {d}", ""])
            s = r.choice([f"the state ought to {a} the old {thing} in {place}{who}{by}", f"Since rents doubled, they want to {a} {place}'s {thing}{by}{who}", f"We demand that {place} will {a} its {thing}{who}{by}", f"it is time to {a} {place}'s old {thing}{who}{by}, using tolls"])
            rows.append((i, s.upper() if r.random() < 0.1 else s))
            truth[i] = k
            i += 1
    return rows, truth


def agreement(got, truth, least=3):
    """Share of the pairs of one demand that meet, and of the pairs that meet which are of one demand."""
    groups = {}
    for i, k in truth.items():
        groups.setdefault(k, []).append(i)
    want = {(a, b) for g in groups.values() if len(g) >= least for a in g for b in g if a < b}
    met = {}
    for i, c in got.items():
        met.setdefault(c, []).append(i)
    have = {(a, b) for g in met.values() for a in g for b in g if a < b}
    return len(want & have) / len(want), len(want & have) / len(have)


def test_same_demands_meet(spark):
    rows, truth = demands()
    df = spark.createDataFrame([(*x, "p") for x in rows] + [(9001, None, "p"), (9002, "", "p"), (9003, "no demand here", "p")], "id long, text string, place string")
    m, c = clusters(df, "id", "text")
    got = {r.id: r.cluster_id for r in m.collect()}
    found, right = agreement(got, truth)
    assert found >= 0.95 and right == 1.0 and not {9001, 9002, 9003} & set(got)
    assert all(min(i for i, x in got.items() if x == k) == k for k in set(got.values()))
    d = {r.cluster_id: r for r in describe(m, c, df, "id", "text").collect()}
    assert set(d) == set(got.values()) and all(r.size == sum(x == r.cluster_id for x in got.values()) and r.typical for r in d.values())


def test_any_sentence(spark):
    rows, _ = demands(6)
    said = ["the state must ban plastic bags in Paris", "We demand that Paris bans plastic bags", "Plastic bags should not be sold in Paris", "Paris needs trams", "Nobody in Rome sells plastic bags"]
    m, _ = clusters(spark.createDataFrame(rows + [(9000 + i, t) for i, t in enumerate(said)], "id long, text string"), "id", "text")
    assert {r.id: r.cluster_id for r in m.where("id >= 9000").collect()} == {9000: 9000, 9001: 9000, 9002: 9000}


def test_misspelt_names(spark):
    rows, truth = demands(7)
    ends = [f"to help {x} by {y}" for x in ("farmers", "bakers", "miners", "nurses", "pilots", "weavers") for y in ("payday", "spring", "autumn", "winter", "summer", "easter", "harvest")]
    made = lambda place, n: [f"the state ought to ban the broken escalators in {place} {e}" for e in ends[:n]]
    # one edit and two edits, each in several wordings; one misspelt text copied often; a place of its own with half the rows
    texts = made("Kidritovleminster", 40) + made("Kidritolveminster", 4) + made("Kidrtovleminsterr", 3) + made("Kudritovleminster", 1) * 9 + made("Kidritovlemunster", 20)
    m, _ = clusters(spark.createDataFrame(rows + [(9000 + i, t) for i, t in enumerate(texts)], "id long, text string"), "id", "text")
    assert {r.id - 9000: r.cluster_id - 9000 for r in m.where("id >= 9000").collect()} == {i: 0 if i < 56 else 56 for i in range(76)}


def test_a_hot_demand(spark):
    rows, truth = demands(8)
    r = random.Random(1)
    hot = [f"{r.choice(['the state ought to', 'they want to', 'it is time to'])} {r.choice(ACTS[0])} the leaking reservoirs in Nolevihaven for {a} by {b}" for a in words(r, 12) for b in ("midsummer", "midwinter", "noon")] * 8
    other = [f"the state ought to {a} the public swings in Nolevihaven {e}" for a in ACTS[2] for e in ("before dusk", "after dusk")]
    texts = hot + other
    m, _ = clusters(spark.createDataFrame(rows + [(9000 + i, t) for i, t in enumerate(texts)], "id long, text string"), "id", "text")
    got = {r.id: r.cluster_id for r in m.collect()}
    found, right = agreement(got, truth | {9000 + i: -1 if i < len(hot) else -2 for i in range(len(texts))})
    assert found >= 0.98 and right == 1.0


def test_no_demands(spark):
    m, c = clusters(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert m.count() == c.count() == 0


@pytest.mark.parametrize("n", [1, 3, 7])
def test_hilbert_neighbours_touch(n):
    levels = 3
    pts = np.array(np.meshgrid(*[np.arange(8)] * min(n, 3))).reshape(min(n, 3), -1).T
    key = packing.hilbert_key(pts, levels)
    assert sorted(key) == list(range(len(pts)))
    walk = pts[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_best_fit():
    r = random.Random(1)
    sizes = [r.randint(0, 100) for _ in range(300)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 11 / 9 * -(-sum(sizes) // 100) + 1  # the guarantee of best fit, longest first


def test_packing_round_trip(spark, vocabulary):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 3, 20, 60, 400])))) for i in range(150)] + [(999, None), (5, "twice")]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, tokens int")
    w = spark.createDataFrame([(1, "gpt2", 256), (2, "cl100k_base", 1024)], "window_id int, tokenizer string, capacity_tokens int")
    rows = packing.pack(df, w, "doc_id", "text", partitions=2).collect()
    for win, cap, name in ((1, 256, "gpt2"), (2, 1024, "cl100k_base")):
        enc = packing.encoder(f"{packing.TOKENIZER_DIR}/{packing.FILES[name]}")
        mine = [x for x in rows if x.window_id == win]
        fill, pieces = {}, {}
        for x in mine:
            fill[x.container_id] = fill.get(x.container_id, 0) + x.tokens
            pieces.setdefault(x.doc_id, []).append(x)
        assert max(fill.values()) <= cap and sum(fill.values()) / (cap * len(fill)) > 0.9
        assert set(pieces) == {d for d, _ in docs}
        for d, t in docs:
            if d == 5:
                continue
            p = sorted(pieces[d], key=lambda x: x.piece)
            size = len(enc.encode_ordinary(t or ""))
            assert sum(x.tokens for x in p) == size and [x.token_start for x in p] == [k * cap for k in range(len(p))]
            assert len(p) == 1 or size > cap
    assert packing.pack(df.where("false"), w, "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, w.selectExpr("window_id", "tokenizer", "0 as capacity_tokens"), "doc_id", "text")


def test_every_window_is_filled(spark):
    df = spark.createDataFrame([(i, "a b c " * i) for i in range(6)], "doc_id long, text string")
    w = spark.range(1_200).selectExpr("cast(id as int) as window_id", "'gpt2' as tokenizer", "cast(id + 5 as int) as capacity_tokens")
    assert packing.pack(df, w, "doc_id", "text").select("window_id").distinct().count() == 1_200


def test_tokens_decode_to_the_text():
    enc = packing.encoder(f"{packing.TOKENIZER_DIR}/{packing.FILES['gpt2']}")
    t = "Grüße, 42 Katzen!\n\n  They're <|endoftext|> here."
    assert enc.decode(enc.encode_ordinary(t)) == t


@pytest.mark.parametrize("text,kind", [
    ("jo.x+y@mail.kel.test", "EMAIL"), ("jo_x at post dot kel dot invalid", "EMAIL"), ("jo (at) kel.example", "EMAIL"), ("jo [at] kel [dot] example", "EMAIL"), ("jo＠kel.test", "EMAIL"),
    ("+999 71 555 0182", "PHONE"), ("+999 (0)46 555 0189", "PHONE"), ("00999-55-501-92-11", "PHONE"), ("(092) 555-0136", "PHONE"), ("080/5550159", "PHONE"), ("037 555 01 45", "PHONE"), ("zero one four five five five zero one", "PHONE"),
    ("933-33-7741", "ID_NUMBER"), ("WXR-960627-5867", "ID_NUMBER"), ("nrv2155/5701", "ID_NUMBER"), ("8904064530K", "ID_NUMBER"), ("Y4475691L", "ID_NUMBER"), ("06 11 83 1044 61", "ID_NUMBER"),
    ("Flat 3, 72 Kotu Road, Trurast", "ADDRESS"), ("280b Brovo Lane, Migro 22420", "ADDRESS"), ("7, rue Tazet, 35541 Merat", "ADDRESS"), ("119 bis avenue Kalo", "ADDRESS"), ("Netolaweg 9, 54985 Kobris", "ADDRESS"), ("Am Sivloplatz 8, Nevod", "ADDRESS"), ("calle Bribri 60, 2º B, 54189 Motol", "ADDRESS"),
])
def test_forms(text, kind):
    full = f"it says {text} so."
    assert form_spans(full) == [(8, 8 + len(text), kind)]


@pytest.mark.parametrize("text", ["Tender 4654006547 closed", "Resolution 430/1 and docket 93-0430-B", "Budget line 99-9-999 rose to 9 999 999 crowns", "Coordinates 48.123, 31.456 mark", "vote on 2024-03-19 passed 692 to 9", "Follow @deskname for", "Bus 109 stops at Vlevli Square", "marched down Felivla Street until"])
def test_no_forms(text):
    assert form_spans(text) == []


def people(seed=0, n=900):
    r = random.Random(seed)
    syl = ["bra", "ko", "li", "mu", "ste", "vi", "za", "gro", "pe", "tu"]
    sur = lambda: "".join(r.choice(syl) for _ in range(3)).capitalize() + r.choice(["ski", "berg", "quist", "man"])
    docs, truth = [], []
    for i in range(n):
        g, s = r.choice(["Anna", "Robert", "Daniel", "Irina", "Kate"]), sur()
        name = f"{g} {s}" if i % 4 else f"{s}, {g}"
        tail = r.choice([f" | +999 71 555 {i:04d}", f", personal number {i:07d}445K.", f" at a{i}@mail.test or call 080/5550159.", ": I have nothing to add.", " told reporters that the matter was closed."])
        pre = r.choice(["", "Mr ", "According to ", "SPEAKER "])
        talk = " ".join(r.choice(["the council put off the vote on the plan.", "several members of the board spoke against the levy.", "the hearing on the bridge went on until late at night."]) for _ in range(12))
        text = f"{talk} {pre}{name}{tail} The {sur()} Institute hosted the debate. Crowds marched down {sur()} Street."
        a = text.index(name)
        docs.append((i, text))
        truth.append((i, a, a + len(name), "PERSON"))
    return docs, truth


def test_persons(spark):
    docs, truth = people()
    df = spark.createDataFrame([(*x, "k") for x in docs] + [(10_000, None, "k"), (10_001, "", "k")], "doc_id long, text string, kind string")
    got = {tuple(r) for r in find_spans(df, "doc_id", "text").where("kind = 'PERSON'").collect()}
    want = set(truth)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.03 * len(want)


def test_shapes_unknown_beforehand_are_learned(spark):
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    docs, want = [], set()
    for i in range(120):
        number, tel, order = f"K{digits(2)}-{digits(5)}-{digits(3)}", f"5{digits(2)}-{digits(3)}-{digits(4)}", f"7{digits(3)}-{digits(6)}"
        text = r.choice([f"Issued with passport {number} in May", f"Listed as {number} | {tel}", f"Her personal number: {number}, phone {tel} by day"]) + f". Order {order} was filed."
        docs.append((i, text))
        want |= {(i, text.index(x), text.index(x) + len(x), k) for x, k in ((number, "ID_NUMBER"), (tel, "PHONE")) if x in text}
    got = {tuple(x) for x in find_spans(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").where("kind in ('ID_NUMBER', 'PHONE')").collect()}
    assert got == want


@pytest.mark.parametrize("text,span,kind", [
    ("call 555-010-1234 now", "555-010-1234", "PHONE"), ("account number: QQ 12 34 56 C", "QQ 12 34 56 C", "ID_NUMBER"), ("IBAN DE89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00", "ID_NUMBER"),
    ("Passport AB1234567", "AB1234567", "ID_NUMBER"), ("lives at 12 Downing St, London", "12 Downing St, London", "ADDRESS"), ("wohnt Hauptstr. 5, 10115 Berlin", "Hauptstr. 5, 10115 Berlin", "ADDRESS"),
])
def test_captions_and_short_forms(text, span, kind):
    assert [(text[a:b], k) for a, b, k in form_spans(text)] == [(span, kind)]


def test_lexicon_is_whole(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "HELD", 2, raising=False)  # the bound that tables once had
    docs, _ = people(2, 300)
    lex, _ = personal_data.learn(spark.createDataFrame(docs, "doc_id long, text string"), "text")
    assert {"anna", "robert", "daniel", "irina", "kate"} <= set(lex.given) and {"board", "levy", "hearing", "bridge"} <= lex.common and len(lex.endings) > 2


def test_sanitised(spark):
    docs, _ = people(1, 300)
    df = spark.createDataFrame(docs + [(10_000, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in sanitise(df, "doc_id", "text").collect()}
    assert out[10_000] is None and all("Institute hosted the debate" in out[i] for i, _ in docs) and sum("[PERSON]" in t for t in out.values() if t) > 280
    assert find_spans(df.where("false"), "doc_id", "text").count() == 0


def test_many_demands_of_one_name(spark):
    rows, truth = demands(9)
    r = random.Random(2)
    first, second = words(r, 12), words(r, 12, "s")
    helped, dates = ([f"{a} {b}" for a, b in zip(words(r, 20), words(r, 20, e))] for e in ("ers", "day"))
    for k in range(120):  # twelve in each place, which share helpers and dates by chance
        place = f"{SYLLABLES[k % 10].capitalize()}lidovurehaven"
        thing, h, d = f"{first[k % 12]} {second[k // 10]}", r.choice(helped), r.choice(dates)
        for _ in range(5):
            s = r.choice(["the state ought to {a} the {t} in {p} to help {h} by {d}", "We demand that {p} will {a} its {t} for {h} until {d}", "it is time to {a} {p}'s {t} by {d} for {h}"])
            truth[i := 9000 + len(rows)] = 1000 + k
            rows.append((i, s.format(a=r.choice(ACTS[k % 3]), t=thing, p=place, h=h, d=d)))
    m, _ = clusters(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    got = {x.id: x.cluster_id for x in m.collect()}
    found, right = agreement({i: c for i, c in got.items() if i >= 9000}, {i: k for i, k in truth.items() if k >= 1000})
    assert found >= 0.95 and right >= 0.95, (found, right)
