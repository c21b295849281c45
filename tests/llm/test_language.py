import numpy as np
from pyspark.sql import functions as F

from stancelake.llm import language as L

TEXT = {
    "en": "the council of the city voted on the new law and the people were told that it would be changed before the end of the year",
    "de": "der rat der stadt hat über das neue gesetz abgestimmt und die leute erfuhren dass es vor dem ende des jahres geändert werden soll",
    "fr": "le conseil de la ville a voté la nouvelle loi et les gens ont appris qu'elle serait changée avant la fin de l'année",
    "es": "el consejo de la ciudad votó la nueva ley y la gente supo que se cambiaría antes del final del año",
    "uk": "рада міста проголосувала за новий закон і люди дізналися що його змінять до кінця року",
}


def rows(spark):
    r = np.random.default_rng(0)
    out = []
    for i in range(300):
        lang = list(TEXT)[i % 5]
        w = TEXT[lang].split()
        body = " ".join(r.choice(w, 14))
        label = lang.upper() if i % 3 else f"{lang}-XX"
        if i % 17 == 0:
            label = "it"
        out.append((str(i), body, label, lang))
    return out


def test_labels(spark):
    want = {"en": "en", "ENG": "en", "en-GB": "en", "pt_BR": "pt", " German ": "de", "ukrainian": "uk", "und": None, "??": None, "": None, "n/a": None, "Deutsch": None, "nl-BE": "nl"}
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "l string")
    got = {r.l: r.x for r in df.select("l", L.label_language(F.col("l")).alias("x")).collect()}
    assert got == {**want, None: None}


def test_held_out_accuracy_and_wrong_labels(spark):
    data = rows(spark)
    df = spark.createDataFrame([(i, b, lab, 1) for i, b, lab, _ in data], "id string, body string, lang string, seg int")
    p = L.paragraphs(df, "id", "body", "lang")
    m = L.fit(p.where("cast(id as int) < 200"), per_label=100)
    got = {r.id: (r.lang, r.confidence) for r in L.classify(p.where("cast(id as int) >= 200"), m).collect()}
    truth = {i: t for i, _, _, t in data}
    assert sum(got[i][0] == truth[i] for i in got) >= 0.97 * len(got) and all(0.11 < c <= 1 for _, c in got.values())


def test_paragraphs(spark):
    df = spark.createDataFrame([("a", "one two\n\n* * *\n \nthree\nfour\n\n12 / 7", "en"), ("b", None, "en"), ("c", "", "en"), ("a", "one two\n\n* * *\n \nthree\nfour\n\n12 / 7", "en")], "id string, body string, lang string")
    got = {(r.id, r.seg, r.text) for r in L.paragraphs(df, "id", "body", "lang").collect()}
    assert got == {("a", 0, "one two"), ("a", 2, "three\nfour")}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([("a", "hello there", None)], "id string, body string, lang string")
    p = L.paragraphs(df, "id", "body", "lang")
    assert abs(L.classify(p, L.fit(p)).first().confidence - 1 / 9) < 1e-9
    e = p.where("false")
    assert L.classify(e, L.fit(e)).count() == 0


def test_bodies(spark):
    s = spark.createDataFrame([("a", 0, "en", 0.9, 100), ("a", 1, "de", 0.9, 20)], "id string, seg int, lang string, confidence double, n_letters int")
    r = L.body_languages(s).first()
    assert (r.lang, r.languages) == ("en", "de,en") and abs(r.confidence - 100 / 120) < 1e-9
