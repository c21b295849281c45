"""Free-entered values -> entries of a reference list, or none.

Canonical names and aliases form one multi-pattern automaton (Aho-Corasick) over
folded tokens.  It finds every mention embedded in a value; of overlapping ones the
longest wins, and a mention stands if only decoration is left beside it (titles,
initials, words such as "city").  The remaining values go to token-set similarity:
each token is read as the reference token it is a spelling of, and an entry is meant
if the token sets agree in their roles (family and given name; kind, field and place
of a body).  What fits no entry, or several equally well, is reported as unmatched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from .names import KIND, PLACE, TITLE, Form, Roles, Tokens, country_of, form, full_names, kind_of, read, sound

UNMATCHED = -1


def _deletes(w: str, k: int) -> set[str]:
    out = {w}
    for _ in range(k):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def edits(a: str, b: str) -> int:
    """Edit distance in which a swap of neighbours counts as one."""
    before, row = [], list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != e))
            if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == e:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return row[-1]


class Spellings:
    """Words by what is left of them after up to two deletions: neighbours within two edits share such a rest."""

    def __init__(self, words: Iterable[str]):
        self.by_rest: dict[str, list[str]] = defaultdict(list)
        for w in words:
            for r in _deletes(w, 2 if len(w) >= 7 else 1):
                self.by_rest[r].append(w)

    def near(self, q: str, k: int) -> list[tuple[str, int]]:
        seen = {w for r in _deletes(q, k) for w in self.by_rest.get(r, ()) if abs(len(w) - len(q)) <= k}
        return [(w, d) for w in seen if (d := edits(q, w)) <= k]


class Reference:
    """Automaton, vocabulary and role indexes of one block of the reference list."""

    def __init__(self, entries: list[tuple[int, list[str], bool, str]]):
        import ahocorasick

        # rows: (item, names, is it a country, the country its description puts it in)
        self.exact: dict[str, set[int]] = defaultdict(set)
        pattern: dict[str, set[int]] = defaultdict(set)
        read_names: list[tuple[int, Tokens, bool]] = []
        lands: set[str] = set()
        for item, names, country, land in entries:
            lands.update(read(land).tok if land else ())
            for n in names:
                t = read(n)
                if not t.tok:
                    continue
                self.exact[n.strip().lower()].add(item)
                pattern[" ".join(t.tok)].add(item)
                read_names.append((item, t, country))
        self.automaton = ahocorasick.Automaton()
        for p, items in pattern.items():
            self.automaton.add_word(f" {p} ", (p, frozenset(items)))
        if pattern:
            self.automaton.make_automaton()
        self.empty = not pattern
        given, family, fields, countries = set(), set(), defaultdict(set), set()
        for _, t, country in read_names:
            kinds = [x for x in t.tok if x in KIND]
            if country:
                countries.update(t.tok)
            elif kinds:
                for x in t.tok:
                    if x not in KIND:
                        fields[x].update(y for y in t.tok if y != x and y not in KIND)
            elif len(t.tok) == 2 and len(t.tok[0]) > 1 and not set(t.tok) & PLACE:
                given.add(t.tok[0])
                family.add(t.tok[1])
        countries |= {x for x in lands if f"{x}" in pattern}
        # a field meets more places than those meet fields
        many = {x for x, places in fields.items() if x not in countries and len(places) > sum(len(fields[y]) for y in places) / len(places)}
        self.roles = Roles(frozenset(given), frozenset(many), frozenset(countries), frozenset(family))
        self.words = sorted({x for _, t, _ in read_names for x in t.tok if len(x) >= 4} | {k for k in KIND if len(k) >= 5})
        self.known = frozenset(x for _, t, _ in read_names for x in t.tok) | frozenset(KIND) | TITLE | PLACE
        self.spellings = Spellings(self.words)
        self.person: dict[str, list[tuple[frozenset[str], int]]] = defaultdict(list)
        self.body: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        self.place: dict[str, set[int]] = defaultdict(set)
        self.sets: dict[int, set[frozenset[str]]] = defaultdict(set)
        for item, t, country in read_names:
            self.sets[item].add(frozenset(t.tok))
            f = form(t, self.roles)
            if f.kind == "person" and f.b and (full_names(f.b), item) not in self.person[f.a]:
                self.person[f.a].append((full_names(f.b), item))
            elif f.kind == "body" and f.c and (f.c, item) not in self.body[(f.a, f.b)]:
                self.body[(f.a, f.b)].append((f.c, item))
            elif f.kind in ("place", "single"):
                self.place[f.a].add(item)

    def respelled(self, t: Tokens) -> Tokens:
        """The tokens with each unknown one read as its nearest reference token, if one is nearest."""
        out = []
        for x in t.tok:
            if x not in self.known and len(x) >= 5 and not country_of(x, self.roles):
                for k in (1, 2) if len(x) >= 7 else (1,):
                    near = self.spellings.near(x, k)
                    best = min((d for _, d in near), default=None)
                    hit = [w for w, d in near if d == best]
                    if len(hit) == 1:
                        x = hit[0]
                    if hit:
                        break
            out.append(x)
        return Tokens(tuple(out), t.comma, t.raw)

    def mentions(self, tok: tuple[str, ...]) -> list[tuple[int, int, frozenset[int]]]:
        """Longest non-overlapping mentions as (first token, number of tokens, items)."""
        if self.empty or not tok:
            return []
        text = " " + " ".join(tok) + " "
        at, begin = {}, 0
        for i, x in enumerate(tok):
            at[begin] = i
            begin += len(x) + 1
        found = []
        for end, (p, items) in self.automaton.iter(text):
            start = end - len(p) - 1
            if start in at:
                found.append((at[start], p.count(" ") + 1, items))
        found.sort(key=lambda m: (-m[1], m[0]))
        taken: set[int] = set()
        out = []
        for a, n, items in found:
            span = set(range(a, a + n))
            if not span & taken:
                taken |= span
                out.append((a, n, items))
        return sorted(out)

    def match(self, value: str) -> tuple[int, float]:
        """(item, score); 1 for a name itself, else the token-set similarity; (-1, 0) if nothing fits."""
        own = self.exact.get(value.strip().lower(), ())
        if len(own) == 1:
            return next(iter(own)), 1.0
        t = read(value)
        if not t.tok:
            return UNMATCHED, 0.0
        for tokens in (t, self.respelled(t)):
            got = self._mentioned(tokens)
            if got is None:
                got = self._by_roles(form(tokens, self.roles))
            if got is not None:
                return got, self.similarity(t, tokens, got)
        return UNMATCHED, 0.0

    def similarity(self, typed: Tokens, read_: Tokens, item: int) -> float:
        """Token-set similarity of a value and its entry, below 1: letters of shared tokens over letters of all.

        A token that had to be respelt counts with the share of its letters that were right.
        """
        def share(own: frozenset[str]) -> float:
            right = total = 0.0
            for a, b in zip(typed.tok, read_.tok):
                total += len(b)
                if b in own:
                    right += len(b) * (1 - edits(a, b) / max(len(a), len(b)))
                elif any(x.startswith(b) for x in own):  # an initial or a cut word
                    right += len(b)
            return right / max(total + sum(len(x) for x in own if x not in read_.tok), 1e-9)

        return round(0.1 + 0.89 * max(map(share, self.sets[item]), default=0.0), 4)

    def _mentioned(self, t: Tokens) -> int | None:
        ms = self.mentions(t.tok)
        if len(ms) == 2 and t.comma and t.tok[ms[1][0]] in self.roles.countries and ms[0][1] == t.comma:
            ms = ms[:1]  # a place and its country
        if len(ms) != 1 or len(ms[0][2]) != 1:
            return None
        a, n, items = ms[0]
        rest = [x for i, x in enumerate(t.tok) if not a <= i < a + n]
        titled = any(x in TITLE for x in rest)
        country = [x for x in rest if country_of(x, self.roles)]
        rest = [x for x in rest if x not in TITLE and x not in PLACE and len(x) > 1]
        if titled or n == 1 and t.comma:
            rest = [x for x in rest if x not in country]
        if rest or titled and n == 1:
            return None
        return next(iter(items))

    def _by_roles(self, f: Form) -> int | None:
        hits: set[int] = set()
        if f.kind in ("person", "single") and f.a in self.person:
            for givens, item in self.person[f.a]:
                fits = bool(givens & full_names(f.b)) or any(g.startswith(f.b) for g in givens) and len(f.b) <= 4 if f.b else not f.initial or any(g.startswith(f.initial) for g in givens)
                if fits:
                    hits.add(item)
        elif f.kind == "body":
            for kind, item in self.body.get((f.a, f.b), ()):
                if kind == f.c or not f.c and kind.startswith(f.initial):
                    hits.add(item)
        if not hits and f.kind in ("place", "single"):
            hits = set(self.place.get(f.a, ()))
        return next(iter(hits)) if len(hits) == 1 else None


def reference_rows(kb: DataFrame) -> DataFrame:
    """``(item_id, names, country, land)``: all distinct non-blank names of each entry, and what its description says."""
    empty = F.array().cast("array<string>")
    names = F.concat(F.array("main_label"), *[F.coalesce(c, empty) for c in ("labels", "aliases", "en_aliases")])
    names = F.array_distinct(F.transform(F.filter(names, lambda x: x.isNotNull() & (F.trim(x) != "")), F.lower))
    return kb.where("item_id is not null").select("item_id", names.alias("names"), F.coalesce(F.lower("description") == "country", F.lit(False)).alias("country"), F.regexp_extract(F.coalesce(F.lower("description"), F.lit("")), r" in (\S+)$", 1).alias("land"))


def map_values(values: DataFrame, kb: DataFrame, column: str) -> DataFrame:
    """``(value, item_id, score)``: one row per distinct value; -1 where no entry is meant.

    Values are lower-cased and stripped; null and blank ones are left out.  An empty reference list
    leaves every value unmatched.  Equally good matches in different entries count as none.
    """
    spark = values.sparkSession
    v = F.regexp_replace(F.lower(F.col(column)), r"(?U)^\s+|\s+$", "")
    distinct = values.select(v.alias("value")).where("value is not null and value <> ''").distinct()
    # one list in every task: mentions, roles and spellings depend on all names together
    entries = [(r["item_id"], list(r["names"]), r["country"], r["land"]) for r in reference_rows(kb).orderBy("item_id").toLocalIterator()]
    held = spark.sparkContext.broadcast(entries)

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        ref = Reference(held.value)
        for pdf in batches:
            got = [ref.match(x) for x in pdf["value"]]
            yield pd.DataFrame({"value": pdf["value"], "item_id": [g[0] for g in got], "score": [g[1] for g in got]})

    return distinct.mapInPandas(run, "value string, item_id long, score double")
