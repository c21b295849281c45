"""Personal information in free text: typed spans and sanitised copies.

What the corpus discloses is learned in one pass over all texts.  Numbers: every
number-like token has a shape (its digits, letters and separators); a shape discloses
a person if it occurs behind a caption such as "passport" or "phone" far more often
than numbers do on the whole (pointwise mutual information in bits), and then counts
with and without caption.  Names: the pass counts how often a term occurs, how often
close to an identifier, and which terms follow it.  A term discloses a person if it
occurs near identifiers far more often than chance, is followed by many different
terms (entropy of its successor) and ends there.  Those terms act as given names; the
endings of the words that follow them tell family names from other words.  E-mail,
dialled numbers and addresses also have forms of their own.  Terms beyond the
thresholds are replaced by their type in the sanitised text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

S = r"[^\S\n]"  # white space inside a line
_NAME = r"[^\W\d_][\w'’\-]+"
_TOWN = rf"(?:,{S}+(?:\d{{4,6}}{S}+[^\W\d_a-zß-ÿ][\w'’\-]+|[^\W\d_a-zß-ÿ][\w'’\-]+(?:{S}+\d{{4,6}}(?!\w))?))?"

EMAIL = re.compile(
    rf"(?<![\w+\-])[\w+\-]+(?:\.[\w+\-]+)*(?:{S}?[@＠]{S}?|{S}*[(\[]{S}?at{S}?[)\]]{S}*)[\w\-]+(?:(?:\.|{S}*[(\[]{S}?dot{S}?[)\]]{S}*|{S}+dot{S}+)[\w\-]+)*(?:\.|{S}*[(\[]{S}?dot{S}?[)\]]{S}*|{S}+dot{S}+)[^\W\d_]{{2,}}"
    rf"|(?<![\w+\-])[\w+\-]+(?:\.[\w+\-]+)*{S}+at{S}+[\w\-]+(?:(?:\.|{S}+dot{S}+)[\w\-]+)*{S}+dot{S}+[^\W\d_]{{2,}}", re.I)
# Captions that announce an identity number or a telephone number.
ID_CAPTIONS = (
    "id", "passport", "personal number", "identity number", "identification number", "tax record", "tax number", "social security number", "insurance number", "account number", "iban",
    "kennnummer", "ausweisnummer", "steuernummer", "numéro d'identité", "passeport", "número de identidad", "pasaporte", "numero di identità", "passaporto", "número de identificação", "passaporte", "paspoort", "numer dowodu")
PHONE_CAPTIONS = ("phone", "telephone", "tel", "mobile", "cell", "fax", "call", "telefon", "handy", "téléphone", "teléfono", "telefono", "telefone", "telefoon")
# Shapes of identity numbers known beforehand (9 a digit, A a letter), prior evidence beside the corpus's own.
KNOWN_SHAPES = ("999-99-9999", "AAA-999999-9999", "AAA9999/9999", "9999999999A", "A9999999A", "99 99 99 9999 99")
#: A number-like token: at least six digits in groups, with letters before or behind.
NUMBER = re.compile(r"(?<![\w/.\-+@＠])(?:[A-Za-z]{1,4}-?)?\d+(?:[ \xa0\-/.]\d+)*(?:-?[A-Za-z]{1,2}| [A-Z])?(?![\w/\-@])")
_HEAD = re.compile(r"(?<!\w)[A-Z]{1,3} $")
_CAPTION = re.compile(rf"(?<![^\W\d_])(?:({'|'.join(ID_CAPTIONS)})|({'|'.join(PHONE_CAPTIONS)}))(?:{S}+(?:no|nr|number|nummer))?[.:#]?{S}{{0,2}}$", re.I)
_LOOK = 40
_DIGIT_WORDS = "zero one two three four five six seven eight nine oh".split()
PHONE = re.compile(
    rf"(?<![\w+])(?:\+|00)\d{{1,3}}(?:[ \xa0.\-/]?\(0\))?(?:[ \xa0.\-/]?\d{{2,4}}){{2,5}}(?![\w])"
    rf"|(?<!\w)\(0\d{{1,4}}\)[ \xa0\-]?\d{{3,4}}[ \xa0\-]\d{{3,4}}(?!\w)"
    rf"|(?<![\w/\-])0\d{{2,4}}[/ \xa0\-]\d{{3}}(?:[ \xa0\-]?\d{{2}}){{2}}(?![\w/\-])"
    rf"|(?<![\w/\-])\+\d{{9,14}}(?!\w)")
SPOKEN = re.compile(rf"\b(?:{'|'.join(_DIGIT_WORDS)})(?:[ \xa0\-](?:{'|'.join(_DIGIT_WORDS)})){{6,}}\b", re.I)
_SPOKEN_SIGN = re.compile(rf"(?:{'|'.join(_DIGIT_WORDS)})[ \xa0\-](?:{'|'.join(_DIGIT_WORDS)})[ \xa0\-](?:{'|'.join(_DIGIT_WORDS)})")  # of the lower-cased text
# Words that make a name the name of a street.
_EN = "Street|Avenue|Lane|Road|Drive|Close|Boulevard|Terrace|Square|Way|Court|Crescent|St\\.?|Rd\\.?|Ave\\.?|Ln\\.?|Blvd\\.?"
_FR = "rue|avenue|place|boulevard|chemin|impasse|quai|allée|cours"
_ES = "calle|avenida|plaza|paseo|camino|ronda|rua|praça|travessa|via|viale|piazza|corso|ulica|ul\\.|aleja|plac|вулиця|вул\\.|проспект"
_DE = "straße|strasse|str\\.|weg|platz|gasse|allee|ufer|damm|straat|laan|plein|gracht"
_ADDRESSES = (
    (re.compile(_EN), re.compile(rf"(?:\b(?:Flat|Apt\.?|Apartment|Unit){S}+\d+\w?,{S}*)?(?<![\w.,/\-])\d{{1,4}}[a-z]?{S}+{_NAME}(?:{S}+{_NAME})?{S}+(?:{_EN})(?!\w){_TOWN}")),
    (re.compile(rf"\b(?:{_FR})\b"), re.compile(rf"(?<![\w.,/\-])\d{{1,4}}(?:{S}*(?:bis|ter|quater))?,?{S}+(?:{_FR}){S}+(?:d[eu]{S}+|des{S}+|de{S}+la{S}+)?{_NAME}{_TOWN}")),
    (re.compile(rf"(?:{_DE}){S}+\d"), re.compile(rf"(?:\b(?:Am|An{S}der|Zum|Zur|Im){S}+)?\b[^\W\d_][\w\-]*(?:{_DE}){S}+\d{{1,4}}[a-z]?\b{_TOWN}")),
    (re.compile(rf"\b(?:{_ES}){S}"), re.compile(rf"\b(?:{_ES}){S}+(?:d[eo]{S}+|del{S}+|da{S}+)?{_NAME},?{S}+\d{{1,4}}[a-z]?\b(?:,{S}*\d{{1,2}}\.?[ºª°](?:{S}*[A-Z]\b)?)?{_TOWN}")),
)
_MAY_HAVE_EMAIL = re.compile(r"[@＠]|[(\[]\s?at\b|\sdot\s", re.I)
# Titles, salutations and roles before a name, and words after one that make it a place or body.
TITLES = frozenset(
    "mr mrs ms miss dr prof professor sir lady herr frau m mme mlle monsieur madame maître señor señora sr sra don doña signor signora sig pan pani пан пані dhr mevrouw meneer senhor senhora "
    "president minister senator governor ambassador general judge mayor speaker witness caller captain colonel".split())
NOT_PERSON = frozenset(
    "street avenue lane road drive close boulevard terrace square way court crescent institute institut university college school hospital foundation museum library theatre bridge centre center "
    "academy library prize hall house park station airport award fund trust company group committee commission council league party union alliance".split())
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: Forms in order of precedence after the identity numbers; a form is looked for where its cheap sign occurs.
FORMS = (("PHONE", re.compile(r"[+0]\d|\(0"), PHONE), ("PHONE", _SPOKEN_SIGN, SPOKEN), *(("ADDRESS", sign, form) for sign, form in _ADDRESSES))
NEAR = 60


def shape_of(number: str) -> str:
    """Digits as 9, letters as A, separators as they are."""
    return re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", number.replace("\xa0", " ")))


def numbers(text: str, shapes: dict[str, str] | None = None) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, shape, caption) of the number-like tokens of at least six digits; the caption is ID_NUMBER, PHONE or empty.

    Capitals set before the digits belong to the number if a caption precedes them or ``shapes`` has that shape.
    """
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if b - a < 6:
            continue
        shape = shape_of(m.group())
        if shape.count("9") < 6:
            continue
        c = _CAPTION.search(text, max(0, a - _LOOK), a)
        head = None if c else _HEAD.search(text, max(0, a - 4), a)
        if head:
            full = shape_of(text[head.start() : b])
            c = _CAPTION.search(text, max(0, head.start() - _LOOK), head.start())
            if c or shapes and full in shapes:
                a, shape = head.start(), full
        yield a, b, shape, "" if not c else "ID_NUMBER" if c.group(1) else "PHONE"


_PRIOR = {x: "ID_NUMBER" for x in KNOWN_SHAPES}


def form_spans(text: str, shapes: dict[str, str] | None = None) -> list[tuple[int, int, str]]:
    """Spans told by their form, in the order of the text; an earlier kind wins where they overlap.

    ``shapes`` are the disclosing number shapes; a captioned number counts whatever its shape.
    """
    shapes = _PRIOR if shapes is None else shapes
    out: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))

    if _MAY_HAVE_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            add(*m.span(), "EMAIL")
    found = [(a, b, shapes.get(shape, ""), caption) for a, b, shape, caption in numbers(text, shapes)]
    for a, b, kind, caption in found:
        if kind == "ID_NUMBER" or caption == "ID_NUMBER":
            add(a, b, "ID_NUMBER")
    for kind, sign, pattern in FORMS:
        if sign.search(text.lower() if sign is _SPOKEN_SIGN else text):
            for m in pattern.finditer(text):
                add(*m.span(), kind)
    for a, b, kind, caption in found:
        if kind == "PHONE" or caption == "PHONE":
            add(a, b, "PHONE")
    return sorted(out)


def _shape(w: str) -> str:
    return "U" if len(w) > 1 and w.isupper() else "T" if w[:1].isupper() else "l"


@dataclass(frozen=True)
class Lexicon:
    """What the corpus discloses: given names with their bits, family-name endings with log odds (short names whole), common words, number shapes with their kind."""

    given: dict[str, float] = field(default_factory=dict)
    endings: dict[str, float] = field(default_factory=dict)
    common: frozenset[str] = frozenset()
    shapes: dict[str, str] = field(default_factory=lambda: dict(_PRIOR))

    def family(self, word: str) -> float:
        """Log odds that a word is a family name, by its ending."""
        w = word.lower().rsplit("-", 1)[-1]
        if len(w) <= 3:
            return self.endings.get(f"^{w}", -3.0)
        for n in (5, 4, 3):
            if len(w) > n and w[-n:] in self.endings:
                return self.endings[w[-n:]]
        return -3.0


_CAPITAL = re.compile(r"(?<![^\W\d_])(?<![^\W\d_]['’\-])[^\W\d_a-zß-ÿ][^\W\d_]*(?:['’\-][^\W\d_]+)*")


def _counts(batches: Iterable) -> Iterator:
    """Rows ``(w, nxt, a, b, c)``: terms with occurrences, capitals and nearness; pairs with occurrences and ends; shapes with occurrences and captions."""
    import pandas as pd

    seen, caps, near, pairs, ends = Counter(), Counter(), Counter(), Counter(), Counter()
    shapes: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])

    def flush() -> pd.DataFrame:
        rows = [(w, "", n, caps[w], near[w]) for w, n in seen.items() if len(w) > 1]
        rows += [(w, x, n, ends[w, x], 0) for (w, x), n in pairs.items()]
        rows += [(w, "#", *v) for w, v in shapes.items()]
        for c in (seen, caps, near, pairs, ends, shapes):
            c.clear()
        return pd.DataFrame(rows, columns=["w", "nxt", "a", "b", "c"])

    for pdf in batches:
        for text in pdf["text"]:
            if not text:
                continue
            for _, _, shape, caption in numbers(text):
                v = shapes[shape]
                v[0] += 1
                v[1] += caption == "ID_NUMBER"
                v[2] += caption == "PHONE"
            spans = form_spans(text)
            parts, at = [], 0
            for a, b, _ in spans:  # the identifiers' own words do not count
                parts += [text[at:a], "0" * (b - a)]
                at = b
            rest = "".join([*parts, text[at:]])
            words = WORD.findall(rest)
            low = [w.lower() for w in words]
            seen.update(low)
            caps.update([x for w, x in zip(words, low) if w[0].isupper()])
            close: dict[int, str] = {}
            for a, b, _ in spans:
                left = rest.rfind("\n", max(0, a - NEAR - 40), a) + 1 or max(0, a - NEAR - 40)
                close.update((m.start(), m.group()) for m in WORD.finditer(rest, left, a) if a - m.end() <= NEAR)
                right = rest.find("\n", b, b + NEAR + 40)
                close.update((m.start(), m.group()) for m in WORD.finditer(rest, b, right if right >= 0 else min(len(rest), b + NEAR + 40)) if m.start() - b <= NEAR)
            near.update([w.lower() for w in close.values()])
            big = [(m.start(), m.end(), m.group()) for m in _CAPITAL.finditer(rest)]
            big = [t for t in big if t[2][0].isupper()]
            for i in range(len(big) - 1):
                _, b, w = big[i]
                a2, b2, x = big[i + 1]
                if not _joined(rest, b, a2) or len(w) < 2:
                    continue
                k = i + 2
                if len(x) == 1 and rest[b2 : b2 + 1] == "." and k < len(big) and _joined(rest, b2 + 1, big[k][0]):
                    a2, b2, x = big[k]
                    k += 1
                if len(x) > 1:
                    more = k < len(big) and len(big[k][2]) > 1 and _joined(rest, b2, big[k][0])
                    key = (w.lower(), x.lower())
                    pairs[key] += 1
                    ends[key] += not more
        if len(seen) + len(pairs) > 400_000:
            yield flush()
    yield flush()


def _joined(text: str, a: int, b: int) -> bool:
    """Only white space of one line between two words."""
    gap = text[a:b]
    return gap.isspace() and "\n" not in gap


def learn_shapes(counts: DataFrame, bits: float = 2.0, least: float = 0.1) -> dict[str, str]:
    """Shape -> kind of the number shapes that disclose a person.

    A shape does if a share of at least ``least`` of its occurrences is captioned and that is ``bits`` more than
    numbers are on the whole.  The shapes known beforehand count as four occurrences, two of them captioned.
    """
    t = counts.where("nxt = '#'").select("w", F.col("a").alias("n"), F.col("b").alias("id"), F.col("c").alias("tel"))
    total = t.agg(F.sum("n").alias("n"), F.sum("id").alias("id"), F.sum("tel").alias("tel")).first()
    n = max(total["n"] or 0, 1)
    prior = F.when(F.col("w").isin(*KNOWN_SHAPES), 2).otherwise(0)
    share = (F.col("id") + prior) / (F.col("n") + 2 * prior)
    tel = F.col("tel") / F.col("n")

    def beyond(p: Column, base: float) -> Column:
        return (p >= least) & (F.log2(p / F.lit(max(base, 1e-6))) >= F.lit(min(bits, -np.log2(max(base, 1e-6)) / 2)))

    kept = t.where((F.col("id") + prior >= 2) & beyond(share, (total["id"] or 0) / n) | (F.col("tel") >= 2) & beyond(tel, (total["tel"] or 0) / n))
    out = {r["w"]: "ID_NUMBER" if r["id"] + 2 * (r["w"] in KNOWN_SHAPES) >= r["tel"] else "PHONE" for r in kept.toLocalIterator()}  # one row a disclosing shape
    gone = {r["w"] for r in t.where(F.col("w").isin(*KNOWN_SHAPES)).collect()} - set(out)  # at most the known shapes
    return {k: v for k, v in {**_PRIOR, **out}.items() if k not in gone}


def learn(docs: DataFrame, text: str, bits: float = 1.0, entropy: float = 1.5) -> tuple[Lexicon, DataFrame]:
    """The lexicon and the table of terms ``(term, occurrences, near, bits, successors, entropy, ends)``.

    Counts cover all texts.  ``bits`` and ``entropy`` are the disclosure thresholds.  Only the terms
    beyond them, all of them, travel to the tasks.
    """
    raw = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(_counts, "w string, nxt string, a long, b long, c long")
    from ..session import materialize

    counts = materialize(raw.groupBy("w", "nxt").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("c").alias("c")), "pii-counts")
    shapes = learn_shapes(counts)
    words = counts.where("nxt = ''").select("w", F.col("a").alias("n"), F.col("b").alias("cap"), F.col("c").alias("near"))
    total = words.agg(F.sum("n").alias("n"), F.sum("near").alias("near")).first()
    base = (total["near"] or 0) / max(total["n"] or 0, 1)
    pairs = counts.where("nxt <> '' and nxt <> '#'").select("w", "nxt", F.col("a").alias("n"), F.col("b").alias("ends"))
    follow = pairs.groupBy("w").agg(
        F.sum("n").alias("pairs"), F.count("*").alias("successors"), F.sum("ends").alias("ends"),
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    terms = words.join(follow, "w").withColumn("bits", F.log2((F.col("near") + 0.5 * base) / ((F.col("n") + 0.5) * F.lit(max(base, 1e-9)))))
    # few occurrences bound the entropy from above, so it is asked for relative to what they allow
    enough = F.col("entropy") >= F.least(F.lit(entropy), 0.6 * F.log2(F.col("pairs")))
    # the successor ends the name, and most occurrences have one
    named = (F.col("ends") >= 0.6 * F.col("pairs")) & (F.col("cap") >= 0.6 * F.col("n")) & (F.col("pairs") >= 0.4 * F.col("cap"))
    given = terms.where((F.col("bits") >= bits) & enough & named & (F.col("pairs") >= 2) & (F.col("successors") >= 2) & (F.length("w") > 2) & ~F.col("w").isin(*TITLES) & ~F.col("w").isin(*NOT_PERSON))
    top = given.orderBy(F.desc("n"), "w").select("w", "bits").toPandas()  # one row a given name
    first = dict(zip(top["w"], top["bits"].astype(float)))
    known = docs.sparkSession.createDataFrame(top[["w"]]) if len(top) else None
    endings: dict[str, float] = {}
    if known is not None:
        def tails(c: str) -> list:
            return [F.when(F.length(c) <= 3, F.concat(F.lit("^"), c)), *[F.when(F.length(c) > n, F.substring(c, -n, n)) for n in (3, 4, 5)]]

        fam = pairs.join(F.broadcast(known), "w").where(~F.col("nxt").isin(*NOT_PERSON)).select(F.explode(F.array(*tails("nxt"))).alias("e"), "n").where("e is not null").groupBy("e").agg(F.sum("n").alias("f"))
        any_ = words.select(F.explode(F.array(*tails("w"))).alias("e"), "n").where("e is not null").groupBy("e").agg(F.sum("n").alias("n"))
        odds = fam.join(any_, "e").withColumn("odds", F.log2((F.col("f") + 0.25) / (F.greatest(F.col("n") - F.col("f"), F.lit(0)) + 0.5)))
        e = odds.where("f >= 2").orderBy(F.desc("f"), "e").select("e", "odds").toPandas()  # one row an ending of up to five letters
        endings = dict(zip(e["e"], e["odds"].astype(float)))
    com = words.where((F.col("cap") < 0.5 * F.col("n")) & (F.col("n") >= 3)).select("w").toPandas()  # one row a word of three uses
    return Lexicon(first, endings, frozenset(com["w"]) - frozenset(first), shapes), terms


_INITIAL = re.compile(rf"(?<![\w@.\-])([^\W\d_a-z])\.(?:{S}*[^\W\d_a-z]\.)?\s{{1,3}}(?=[^\W\d_])")


def person_spans(text: str, lex: Lexicon, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Names of persons outside the spans already taken."""
    toks = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    low = [t[2].lower() for t in toks]
    blocked = np.zeros(len(text) + 1, bool)
    for a, b, _ in taken:
        blocked[a:b] = True
    n = len(toks)
    out: list[tuple[int, int, str]] = []
    last = -1

    def family(i: int, least: float = -1.0) -> bool:
        return i < n and len(low[i]) > 1 and low[i] not in lex.common and low[i] not in lex.given and low[i] not in TITLES and not blocked[toks[i][0]] and lex.family(low[i]) > least

    def capital(i: int) -> bool:
        return toks[i][2][0].isupper()

    def closed(i: int) -> bool:
        """The name is not part of a street's or a body's name."""
        return not (i + 1 < n and low[i + 1] in NOT_PERSON and text[toks[i][1] : toks[i + 1][0]].isspace()) and text[toks[i][1] : toks[i][1] + 1] not in ("@",)

    # a common word begins no name, neither as given nor as family name
    for i in [i for i, x in enumerate(low) if x not in lex.common]:
        a, b, w = toks[i]
        if a <= last or blocked[a]:
            continue
        if low[i] in lex.given or i + 1 < n and _possible_given(low[i], w, lex) and family(i + 1) and capital(i) and lex.family(low[i + 1]) > 1.0 and (i == 0 or low[i - 1] not in ("the",)):
            j = i + 1
            while j < n and len(toks[j][2]) == 1 and toks[j][2].isupper() and text[toks[j][1] : toks[j][1] + 1] == "." and text[toks[j - 1][1] : toks[j][0]].strip(" .\xa0\t") == "":
                j += 1
            between = text[toks[j - 1][1] + (j > i + 1) : toks[j][0]] if j < n else "x"
            if j < n and between.isspace() and between.count("\n") < 2 and (family(j) or capital(j) and low[j] not in lex.common and low[j] not in NOT_PERSON and low[j] not in lex.given and (len(low[j]) > 3 or family(j, 0.0)) and low[i] in lex.given) and closed(j) and _shape(w)[0] in _agree(toks[j][2]):
                out.append((a, toks[j][1], "PERSON"))
                last = toks[j][1]
                continue
        if family(i, -2.5) and closed(i):
            # family name, given name: the given name behind the comma speaks for it
            if i + 1 < n and text[b : toks[i + 1][0]].strip(" \xa0\t") == "," and low[i + 1] in lex.given and not blocked[toks[i + 1][0]]:
                end, j = toks[i + 1][1], i + 2
                m = re.compile(r"[ \xa0]+[^\W\d_a-z]\.").match(text, end)
                if m and not (j + 1 < n and text[m.end() : toks[j + 1][0]].isspace() and family(j + 1)):
                    end = m.end()
                follow = i + 2
                if not (follow < n and text[toks[i + 1][1] : toks[follow][0]].isspace() and family(follow) and capital(follow)):
                    out.append((a, end, "PERSON"))
                    last = end
                    continue
            # initial, family name
            k = i - 1
            if family(i) and k >= 0 and len(toks[k][2]) == 1 and toks[k][2].isalpha() and re.fullmatch(r"\.[^\S\n]*\n?[^\S\n]*", text[toks[k][1] : a]) and toks[k][0] > last:
                start = toks[k][0]
                while k >= 1 and len(toks[k - 1][2]) == 1 and text[toks[k - 1][1] : toks[k][0]].strip() == ".":
                    k -= 1
                    start = toks[k][0]
                out.append((start, b, "PERSON"))
                last = b
                continue
            # title, family name
            if i >= 1 and low[i - 1] in TITLES and text[toks[i - 1][1] : a].strip(" .\xa0") == "" and lex.family(low[i]) > 0:
                out.append((a, b, "PERSON"))
                last = b
    return out


def _possible_given(low: str, w: str, lex: Lexicon) -> bool:
    return len(low) > 2 and low not in lex.common and low not in TITLES and low not in NOT_PERSON and lex.family(low) < 0


def _agree(w: str) -> str:
    return {"T": "Tl", "U": "UT", "l": "lT"}[_shape(w)]


def find_spans(docs: DataFrame, doc_id: str, text: str, lexicon: Lexicon | None = None) -> DataFrame:
    """``(doc_id, start_pos, end_pos, kind)``: every span of personal information, counted in characters.

    Spans of a document never overlap.  Null and empty texts have none; a repeated document is
    reported each time; whole texts are read.
    """
    lex = learn(docs, text)[0] if lexicon is None else lexicon
    held = docs.sparkSession.sparkContext.broadcast(lex)  # tables of short words and shapes, whole

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        lx = held.value
        for pdf in batches:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                if t:
                    forms = form_spans(t, lx.shapes)
                    rows.extend((d, *s) for s in sorted(forms + person_spans(t, lx, forms)))
            yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos", "kind"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, start_pos int, end_pos int, kind string")


def sanitise(docs: DataFrame, doc_id: str, text: str, lexicon: Lexicon | None = None) -> DataFrame:
    """``(doc_id, text, spans)``: the texts with typed placeholders such as ``[PERSON]``; null stays null."""
    lex = learn(docs, text)[0] if lexicon is None else lexicon
    held = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        lx = held.value
        for pdf in batches:
            texts, counts = [], []
            for t in pdf["text"]:
                if not t:
                    texts.append(t), counts.append(0)
                    continue
                forms = form_spans(t, lx.shapes)
                spans = sorted(forms + person_spans(t, lx, forms))
                parts, at = [], 0
                for a, b, kind in spans:
                    parts += [t[at:a], f"[{kind}]"]
                    at = b
                texts.append("".join([*parts, t[at:]])), counts.append(len(spans))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "spans": counts})

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text string, spans int")
