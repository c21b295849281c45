"""Forms of names typed by people: tokens without order, spelling or decoration.

A name is read as tokens, each folded to what it sounds like (accents, doubled
letters and common transcriptions removed).  With a vocabulary of roles the
tokens become a person (given name, family name), a body (kind, field, place), a
place, or anything else.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache, cached_property

from .trie_join import Trie

# General English words, in their usual spelling.
STOP = frozenset("of the for and in at de la le von van der".split())
TITLES = ("mr mrs ms miss dr prof professor sir lady lord president vice prime minister deputy mayor governor senator ambassador general colonel captain judge "
          "chancellor secretary chairman chairwoman director king queen prince princess bishop former acting").split()
KINDS = ("association agency union society federation league cooperative guild forum committee council department institute ministry commission board bureau office "
         "authority party movement alliance coalition chamber club bank company group organisation foundation network congress assembly government court university").split()
SHORT = {"assn": "association", "assoc": "association", "dept": "department", "min": "ministry", "inst": "institute", "cncl": "council", "soc": "society", "fed": "federation", "cttee": "committee",
         "agcy": "agency", "coop": "cooperative", "un": "union", "univ": "university", "org": "organisation", "govt": "government", "comm": "commission", "foru": "forum"}
PLACES = "city town municipality commune area district place village port region county borough".split()
NICK = {
    "alexander": "alex sasha sandy xander", "andrew": "andy drew", "anna": "anya annie ann", "barbara": "basia barb", "benjamin": "ben benny", "catherine": "kate cathy katie", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave davy", "dorothea": "dora dot", "edward": "ed eddie ted", "ekaterina": "katya katia", "elizabeth": "liz beth lizzie eliza", "francesca": "fran frankie", "frederick": "fred freddy",
    "gabriel": "gabe", "georgina": "gina georgie", "gregory": "greg", "harold": "harry hal", "helena": "lena nell", "henrietta": "etta hetty", "ignatius": "iggy", "irina": "ira", "isabella": "bella izzy",
    "jacob": "jake", "johanna": "jo hanna", "jonathan": "jon", "joseph": "joe joey", "katarina": "kata kat", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len leo", "ludmila": "luda mila",
    "magdalena": "magda lena", "margaret": "maggie meg peggy", "matthias": "matt", "michael": "mike mick", "mikhail": "misha", "nadezhda": "nadia", "natalia": "natasha", "nicholas": "nick nicky", "olga": "olya",
    "oliver": "ollie", "patricia": "pat patty trish", "pavel": "pasha", "philippa": "pippa", "quentin": "quin", "raymond": "ray", "rebecca": "becky", "robert": "bob rob bobby", "rosalind": "ros rosie",
    "samuel": "sam sammy", "sebastian": "seb", "sophia": "sophie", "stanislav": "stas", "susanna": "sanna sue susie", "tatiana": "tanya", "theodore": "theo ted", "thomas": "tom tommy", "ursula": "ulla",
    "valentina": "valya val", "victoria": "vicky tori", "vincent": "vince", "vladislav": "vlad", "walter": "walt wally", "wilhelmina": "mina willa", "william": "bill will billy", "xenia": "xen", "yevgenia": "zhenya",
    "yuri": "yura", "zachary": "zach zack", "zuzanna": "zuza",
}


def plain(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in t if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("ß", "ss")


def sound(t: str) -> str:
    """A token as it sounds: transcriptions of one letter and doubled letters fall together."""
    t = t.replace("ph", "f")
    t = t[:1] + t[1:].replace("h", "") if t[:1] != "h" else t[1:].replace("h", "") and "h" + t[1:].replace("h", "")
    t = soft(t)
    return re.sub(r"(.)\1+", r"\1", t) or t


def soft(t: str) -> str:
    """The letters that transcriptions confuse fall together; doubled letters stay."""
    return t.replace("ou", "u").translate(str.maketrans("wyczq", "viksk"))


KIND = {sound(k): k for k in KINDS} | {sound(a): k for a, k in SHORT.items()}
TITLE = frozenset(map(sound, TITLES))
PLACE = frozenset(map(sound, PLACES))
STOPS = frozenset(map(sound, STOP))
_NICK: dict[str, frozenset[str]] = {}
for _full, _all in NICK.items():
    for _n in [_full, *_all.split()]:
        _NICK[sound(_n)] = _NICK.get(sound(_n), frozenset()) | {sound(_full)}


def full_names(given: str) -> frozenset[str]:
    """The full given names a given name may stand for."""
    return _NICK.get(given, frozenset({given}))


_KINDS = Trie(k for k in KIND if len(k) >= 5)


@cache
def kind_of(t: str) -> str | None:
    """The kind of body a token names, with at most one typing error or cut short, in words of four letters or more."""
    if t in KIND:
        return KIND[t]
    hit = sorted({KIND[w] for w, _ in _KINDS.near(t, 1)} or {KIND[w] for w in KIND if w.startswith(t)}) if len(t) >= 4 else []
    return hit[0] if len(hit) == 1 else None


@dataclass(frozen=True)
class Tokens:
    """Folded tokens of a name; ``comma`` is the number of tokens before the first comma (0: none)."""

    tok: tuple[str, ...]
    comma: int
    raw: tuple[str, ...] = ()


def read(name: str) -> Tokens:
    """Tokens of a name without stop words; second halves of hyphenated words are dropped."""
    s = plain(name).replace("co-op", "coop").replace("’", "'")
    s = re.sub(r"'s\b", " ", s).replace("'", "")
    s = re.sub(r"(?<=\w)-\w+", " ", s)
    out: list[str] = []
    raw: list[str] = []
    comma = 0
    for part in re.split(r"(,)", s):
        if part == ",":
            comma = comma or len(out)
            continue
        for w in re.findall(r"[^\W_]+", part):
            t = sound(w)
            if t not in STOPS or len(w) == 1:
                out.append(t)
                raw.append(w)
    if not out:
        raw = re.findall(r"[^\W_]+", s)
        out = [sound(w) for w in raw]
    return Tokens(tuple(out), comma if comma < len(out) else 0, tuple(raw))


@dataclass(frozen=True)
class Roles:
    """Which tokens act as given names, fields of bodies and countries; whole sets, as large as their vocabulary."""

    given: frozenset[str] = frozenset()
    fields: frozenset[str] = frozenset()
    countries: frozenset[str] = frozenset()
    family: frozenset[str] = field(default_factory=frozenset)

    @cached_property
    def _field_trie(self) -> Trie:
        return Trie(f for f in self.fields if len(f) >= 4)

    @cached_property
    def _given_trie(self) -> Trie:
        return Trie(g for g in self.given if len(g) >= 4)

    def near_given(self, t: str) -> str | None:
        """The one given name that a token of four letters or more is a single error away from."""
        key = ("", t)
        if key not in self._fields_read:
            hit = [g for g, _ in self._given_trie.near(t, 1)] if len(t) >= 4 else []
            self._fields_read[key] = hit[0] if len(hit) == 1 else None
        return self._fields_read[key]

    @cached_property
    def _fields_read(self) -> dict[tuple[str, str], str | None]:
        return {}

    def near_field(self, t: str, raw: str) -> str | None:
        """The one field that a token is a misspelling of: one error in words of four letters, two in longer ones."""
        key = (t, raw)
        if key not in self._fields_read:
            best: dict[str, int] = {}
            for x in {t, soft(raw)}:
                if 4 <= len(x) <= 14:
                    for f, d in self._field_trie.near(x, 1 if len(x) < 5 else 2):
                        best[f] = min(d, best.get(f, 9))
            least = min(best.values(), default=9)
            hit = [f for f, d in best.items() if d == least]
            self._fields_read[key] = hit[0] if len(hit) == 1 else None
        return self._fields_read[key]


@dataclass(frozen=True)
class Form:
    """kind: person (a: family name, b: given name, initial), body (a: place, b: field, c: kind of body), place (a), single word (a), other (a)."""

    kind: str
    a: str = ""
    b: str = ""
    c: str = ""
    initial: str = ""


def country_of(t: str, roles: Roles) -> str | None:
    """The country of a country name or of its adjective."""
    if t in roles.countries:
        return t
    for suf in ("n", "an", "ian", "ik", "is", "ese", "i"):
        if len(t) > len(suf) + 3 and t.endswith(suf) and t[: -len(suf)] in roles.countries:
            return t[: -len(suf)]
    return None


_FIRST = frozenset(k[0] for k in KIND)


def is_code(t: str, fields: Iterable[str]) -> bool:
    """A folded token made of a kind's first letter and the beginning of a field ("sjust" for a society of justice)."""
    if t[:1] not in _FIRST or len(t) < 4:
        return False
    # folding drops h and runs equal letters together
    return any(f.startswith(t) or len(t) >= 4 and f.replace("h", "").startswith(t[1:]) for f in fields)


def form(tokens: Tokens, roles: Roles) -> Form:
    """The form of a name; see the module's text."""
    tok, comma = list(tokens.tok), tokens.comma
    kinds = [i for i, t in enumerate(tok) if t in KIND] or [i for i, t in enumerate(tok) if kind_of(t) and t not in roles.given and t not in roles.fields]
    if kinds and len(tok) >= 2:
        i = kinds[0]
        kind = kind_of(tok[i])
        if len(tok) >= 3 and not any(t in roles.fields for j, t in enumerate(tok) if j != i):
            near = {j: roles.near_field(t, tokens.raw[j] if j < len(tokens.raw) else t) for j, t in enumerate(tok) if j != i and not country_of(t, roles)}
            near = {j: f for j, f in near.items() if f}
            if len(near) == 1:
                for j, f in near.items():
                    tok[j] = f
        rest = [country_of(t, roles) or t for j, t in enumerate(tok) if j != i]
        rest = [t for t in rest if t not in PLACE and len(t) > 2] or rest
        fields = [t for t in rest if t in roles.fields]
        if len(rest) >= 2 and fields:
            f = fields[0] if len(fields) == 1 else next((t for t in fields if t not in roles.countries), fields[0])
            place = [t for t in rest if t != f]
            return Form("body", " ".join(sorted(place)), f, kind)
        return Form("body", " ".join(sorted(rest)), "", kind)
    if len(tok) == 2:
        for i in (0, 1):
            short, place = tokens.raw[i] if tokens.raw else tok[i], tok[1 - i]
            if 4 <= len(short) <= 7 and sound(short) not in roles.given:
                cut = sound(short[1:])
                hit = [f for f in roles.fields if f.startswith(cut) or len(cut) >= 4 and f.startswith(cut[:-1])]
                if len(cut) >= 3 and len(hit) == 1 and any(k[0] == short[0] for k in KINDS):
                    return Form("body", country_of(place, roles) or place, hit[0], "", short[0])
    titled = False
    while len(tok) > 1 and tok[0] in TITLE:
        tok.pop(0)
        comma = 0
        titled = True
    if titled and len(tok) > 1 and country_of(tok[0], roles):
        tok.pop(0)
    names = [t for t in tok if t not in PLACE]
    if names and len(names) < len(tok):
        return Form("place", " ".join(sorted(names)))
    initials = [t for t in tok if len(t) == 1]
    words = [t for t in tok if len(t) > 1]
    if len(words) == 1 and (initials or titled or words[0] in roles.family):
        return Form("person", words[0], "", "", initials[0] if initials else "")
    if len(words) == 2:
        x, y = words
        if y in roles.countries and x not in roles.given and not titled and x not in roles.family:
            return Form("place", x)
        if comma == 1 and x in roles.given and y not in roles.given:
            return Form("person", y, x)
        if comma == 1 or y in roles.given and x not in roles.given:
            return Form("person", x, y)
        if x in roles.given or titled or x in _NICK:
            return Form("person", y, x)
        if y in _NICK:
            return Form("person", x, y)
        if initials:
            return Form("person", y, x)
        near = roles.near_given(x), roles.near_given(y)
        if bool(near[0]) != bool(near[1]):
            return Form("person", y, near[0]) if near[0] else Form("person", x, near[1])
        return Form("other", " ".join(sorted(words)))
    if len(words) == 1:
        return Form("single", words[0])
    return Form("other", " ".join(sorted(tok)))
