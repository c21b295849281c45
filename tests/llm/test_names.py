import itertools
import random

from stancelake.llm.name_variants import name_variants
from stancelake.llm.names import read, sound
from stancelake.llm.reference_mapping import Spellings, edits, map_values
from stancelake.llm.trie_join import Trie, trie_join


def test_distance_of_swaps():
    assert edits("abcd", "abdc") == 1 and edits("ca", "abc") == 3 and edits("", "ab") == 2 and edits("x", "x") == 0


def test_trie_finds_what_brute_force_finds():
    r = random.Random(1)
    ws = ["".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(80)]
    t = Trie(ws)
    for q in ws[:30]:
        for k in (1, 2):
            assert {w for w, _ in t.near(q, k)} == {w for w in ws if edits(q, w) <= k}


def test_trie_join_equals_brute_force(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcde") for _ in range(r.randint(5, 10))) for _ in range(60)]
    ws = set(base)
    for b in base:
        for _ in range(3):
            x = list(b)
            for _ in range(r.randint(1, 2)):
                i = r.randrange(len(x) - 1)
                op = r.randrange(4)
                if op == 0:
                    x[i], x[i + 1] = x[i + 1], x[i]
                elif op == 1:
                    x[i] = r.choice("abcde")
                elif op == 2 and len(x) > 5:
                    del x[i]
                else:
                    x.insert(i, r.choice("abcde"))
            ws.add("".join(x))
    df = spark.createDataFrame([(w,) for w in ws] + [(None,), ("",)], "word string")
    for k in (1, 2):
        got = {(a.query, a.word) for a in trie_join(df, df, k).collect()}
        assert got == {(a, b) for a, b in itertools.permutations(ws, 2) if edits(a, b) <= k}
    assert trie_join(df.where("false"), df, 1).count() == 0


def test_spellings_index():
    s = Spellings(["department", "union"])
    assert s.near("departmnet", 1) == [("department", 1)] and s.near("unoin", 1) == [("union", 1)] and s.near("onion", 1) == [("union", 1)]


def test_folding():
    assert sound("catherine") == sound("katherine") and sound("pfeiffer") != sound("weber")
    assert read("O'Neill,  Mary-Jane").tok == ("oneil", "mari") and read("O'Neill,  Mary-Jane").comma == 1
    assert read("!!!").tok == ()


PEOPLE = {
    "ministry": ["Ministry of Finance of Rastovia", "rastovian finance ministry", "the ministry of finance of rastovia", "Rastovia's finance ministry", "min. of finance, rastovia", "finance ministry (rastovia)"],
    "person": ["Catherine Zezebirovic", "kate zezebirovic", "Zezebirovic, Catherine", "c. zezebirovic", "Dr. Catherine Zezebirovic", "cathérine zézebirovíc", "catherine-maria zezebirovic", "catherine zezebirvoic"],
    "brother": ["Gregory Zezebirovich-not"],
    "place": ["Bramelinegrad", "city of bramelinegrad", "bramelinegrad (town)", "bramelinegrad municipality"],
}
OTHER = [f"{g} {s}" for g in ("catherine", "gregory", "daniel", "anna", "robert") for s in ("tolvanidal", "kurpenash", "vostigebberg", "minlarusen", "dagrotuski", "pelhimovan")]
BODIES = [f"{k} of {f} of {p}" for k in ("ministry", "council", "union") for f in ("finance", "health", "energy", "labour") for p in ("rastovia", "selkaria", "kelmara", "urmidia", "veldoria", "ostrevia")]


def test_variants(spark):
    rows = [n for v in PEOPLE.values() for n in v] + OTHER + BODIES + ["rastovian agency", "selkarian council", "kelmaran union"]
    df = spark.createDataFrame([(n, 1) for n in rows] + [(None, 1), ("  ", 1), (rows[0], 1)], "stakeholder string, name int")
    got = {r.name: r.entity for r in name_variants(df, "stakeholder").collect()}
    assert len(got) == len({n.strip().lower() for n in rows})
    for k in ("ministry", "person", "place"):
        assert len({got[n.lower()] for n in PEOPLE[k]}) == 1, (k, [(n, got[n.lower()]) for n in PEOPLE[k]])
    assert got["ministry of health of rastovia"] != got["ministry of finance of rastovia"] != got["council of finance of rastovia"]
    assert len({got[n] for n in OTHER}) == len(OTHER)


def test_variants_of_nothing(spark):
    assert name_variants(spark.createDataFrame([], "stakeholder string"), "stakeholder").count() == 0
    assert name_variants(spark.createDataFrame([(None,), ("",)], "stakeholder string"), "stakeholder").count() == 0


def test_mapping(spark):
    kb = [(1, "Catherine Zezebirovic", ["catherine zezebirovic"], "rastovian jurist", ["c. zezebirovic"], None), (2, "", ["ministry of finance of rastovia"], None, [], []), (3, "Rastovia", ["rastovia"], "country", None, None),
          (4, "Bramelinegrad", ["bramelinegrad"], "port in rastovia", None, None), (5, "Council of Finance of Rastovia", ["council of finance of rastovia"], None, None, None), (6, "Union of Finance of Kelmara", ["union of finance of kelmara"], None, None, None),
          (7, "Gregory Doublename", ["gregory doublename"], None, None, None), (8, "Anna Doublename", ["anna doublename"], None, None, None), (None, "x", None, None, None, None)]
    k = spark.createDataFrame(kb, "item_id long, main_label string, labels array<string>, description string, aliases array<string>, en_aliases array<string>")
    want = {
        "kate zezebirovic": 1, "zezebirovic, catherine": 1, "prime minister catherine k. zezebirovic": 1, "catherine zezebirvoic": 1, "zezebirovic": 1, "daniel zezebirovic": -1,
        "rastovian finance ministry": 2, "finance ministry (rastovia)": 2, "ministry of health of rastovia": -1, "city of bramelinegrad": 4, "bramelinegrad, rastovia": 4, "bramelinegrda": 4,
        "doublename": -1, "g. doublename": 7, "farmers": -1, "!!!": -1}
    df = spark.createDataFrame([(v, 1) for v in want] + [(None, 1), (" ", 1), ("Farmers ", 2), ("x" * 50_000, 3)], "value string, item_id int")
    got = {r.value: r.item_id for r in map_values(df, k, "value").collect()}
    assert got.pop("x" * 50_000) == -1
    assert got == want
    assert {r.item_id for r in map_values(df, k.where("false"), "value").collect()} == {-1}


def test_ambiguous_in_a_long_list(spark):
    # more than 10,000 names between two equal entries and a weaker one
    kb = [(1, "robert lindqvist"), (2, "robert lindqvist"), *((i, f"place{i}x") for i in range(3, 10_103)), (20_000, "robert lindqvest")]
    k = spark.createDataFrame([(i, n, None, None, None, None) for i, n in kb], "item_id long, main_label string, labels array<string>, aliases array<string>, en_aliases array<string>, description string")
    df = spark.createDataFrame([("minister robert lindqvist",), ("minister robert lindqvest",)], "value string")
    assert {r.value: r.item_id for r in map_values(df, k, "value").collect()} == {"minister robert lindqvist": -1, "minister robert lindqvest": 20_000}


def test_codes_and_cut_kinds():
    from stancelake.llm.names import Roles, form, is_code, read, sound

    fields = frozenset(map(sound, ["health", "water", "interior", "justice", "trade"]))
    assert all(is_code(sound(x), fields) for x in ("aheal", "swate", "iinte", "sjust", "ctrad")) and not any(is_code(sound(x), fields) for x in ("sana", "walter", "anna", "irina", "tom"))
    r = Roles(frozenset(map(sound, ["jacob", "irina", "walter"])), fields)
    assert form(read("jcob bizizilalini"), r) == form(read("bizizilalini, jacob"), r)
    assert form(read("leag. of bakers, gragritigruholm"), Roles(fields=frozenset({"bakers"}))) == form(read("gragritigruholm bakers league"), Roles(fields=frozenset({"bakers"})))
    assert form(read("rorimutimere association of waatrr"), r) == form(read("association of water of rorimutimere"), r)
    assert form(read("dalyarian society of hetlh"), r).b == form(read("society of health of dalyaria"), r).b


def test_frequent_family_names_are_no_given_names(spark):
    given = ["Walter", "Anna", "Jacob", "Irina", "Robert", "Samuel"]
    rows = [f"{g} {f}" for i, g in enumerate(given) for f in [f"Kobra{x}sen" for x in ("li", "mu", "te", "vo", "za", "pe")]]
    hot = ["Walter Dabosefocu", "Dabosefocu, Walter", "W. Dabosefocu", "Watler Dabosefocu", "Dabosefocu Walter", "Wal. Dabosefocu", "Walt Dabosefocu", "Dr Walter R. Dabosefocu"]
    df = spark.createDataFrame([(x,) for x in rows + hot], "n string")
    e = {r.name: r.entity for r in name_variants(df, "n").collect()}
    assert len({e[x.lower()] for x in hot}) == 1 and len({e[x.lower()] for x in rows}) == len(rows)
