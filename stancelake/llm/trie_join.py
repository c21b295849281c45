"""All pairs of words within a bounded edit distance: tries walked by a Levenshtein automaton.

The words are sharded by segments: a word within k edits of another shares at
least one of the other's k + 1 segments unchanged, so both meet in that
segment's shard.  There the indexed words form a trie, and every query walks it
with one automaton row a letter, leaving a branch as soon as the row's least
value exceeds the bound.  Swapped neighbours count as one edit; a swap across a
segment boundary is covered by sharding the swapped query too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F


class Trie:
    """A set of words; nodes are dicts, the empty key marks a word's end."""

    def __init__(self, words: Iterable[str] = ()):
        self.root: dict = {}
        for w in words:
            self.add(w)

    def add(self, w: str) -> None:
        node = self.root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w

    def near(self, q: str, k: int) -> Iterator[tuple[str, int]]:
        """(word, distance) of all words within k edits of q."""
        first = list(range(len(q) + 1))
        todo = [(self.root, "", first, first)]
        n = len(q)
        while todo:
            node, last, row, before = todo.pop()
            if "" in node and row[n] <= k:
                yield node[""], row[n]
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    v = row[j - 1] if q[j - 1] == c else 1 + min(row[j - 1], row[j], new[j - 1])
                    if last and j > 1 and q[j - 1] == last and q[j - 2] == c and q[j - 1] != c:
                        v = min(v, before[j - 2] + 1)
                    new.append(v)
                if min(new) <= k or last and min(row) < k:
                    todo.append((child, c, new, row))


def _cuts(n: int, k: int) -> list[int]:
    """Ends of the segments. Words often share their endings, so the last segment is the longest."""
    size = max(3, round(0.44 * n / k)) if k and n >= 3 * (k + 1) else n / (k + 1)
    return [round(i * size) for i in range(k + 1)] + [n]


def index_keys(w: str, k: int) -> list[str]:
    """Shard keys of an indexed word: its k + 1 segments."""
    c = _cuts(len(w), k)
    return [f"{s}|{len(w)}|{w[c[s] : c[s + 1]]}" for s in range(k + 1)]


def _swap(w: str, at: int) -> str:
    return w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :] if 0 < at < len(w) else w


def query_keys(q: str, k: int) -> set[str]:
    """Shard keys under which every indexed word within k edits of q is found."""
    out = set()
    for n in range(max(len(q) - k, 1), len(q) + k + 1):
        c = _cuts(n, k)
        forms = {q}
        for b in c[1:-1]:
            if n == len(q):  # swaps across any of the boundaries
                forms |= {_swap(f, b) for f in forms}
            if abs(n - len(q)) < k:  # a swap and other edits before it, which move the boundary
                forms |= {_swap(q, b + d) for d in range(1 - k, k)}
        for f in forms:
            for s in range(k + 1):
                size = c[s + 1] - c[s]
                for at in range(max(c[s] - k, 0), min(c[s] + k, len(f) - size) + 1):
                    out.add(f"{s}|{n}|{f[at : at + size]}")
    return out


def trie_join(queries: DataFrame, index: DataFrame, k: int, shards: int = 48, by: str | None = None) -> DataFrame:
    """``(query, word, distance[, by])``: every word of ``index`` within k edits of a different word of ``queries``.

    Both have a column ``word``, and only words that agree in the column ``by`` are compared; repeated, null and empty words count once or not at all.  Words of
    fewer than k + 1 letters are never within the bound's guarantee and take no part.
    """

    def keyed(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in (batch.iloc[a : a + 1_000] for batch in batches for a in range(0, len(batch), 1_000)):  # a word has up to hundreds of keys
            rows = []
            for w, g, ask in zip(pdf["word"], pdf["grp"], pdf["ask"]):
                for key in query_keys(w, k) if ask else index_keys(w, k):
                    rows.append((f"{key}|{g}", w, g, ask))
            yield pd.DataFrame(rows, columns=["key", "word", "grp", "ask"])

    def walk(pdf):
        import pandas as pd

        rows = set()
        held = pdf[~pdf["ask"]].groupby("key")["word"].agg(list).to_dict()
        tries = {key: Trie(ws) for key, ws in held.items()}
        asked = pdf[pdf["ask"]]
        for key, q, g in zip(asked["key"], asked["word"], asked["grp"]):
            t = tries.get(key)
            if t is not None:
                rows.update((q, w, d, g) for w, d in t.near(q, k) if w != q)
        return pd.DataFrame(list(rows), columns=["query", "word", "distance", "grp"])

    grp = F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit("")
    both = queries.select("word", grp.alias("grp"), F.lit(True).alias("ask")).unionByName(index.select("word", grp.alias("grp"), F.lit(False).alias("ask")))
    both = both.where(F.length("word") > k).distinct()
    rows = both.mapInPandas(keyed, "key string, word string, grp string, ask boolean")
    # queries whose shard holds no indexed word are dropped before the walk
    live = rows.where("not ask").select("key").distinct()
    rows = rows.join(live, "key", "left_semi").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = rows.groupBy("shard").applyInPandas(walk, "query string, word string, distance int, grp string").distinct()
    return found.withColumnRenamed("grp", by) if by else found.drop("grp")
