"""Evaluation passages inside training documents: Wu-Manber multi-pattern search over words.

Every run of ``m`` consecutive words of an evaluation text is a pattern.  The
search looks at the block of two words that ends the window: the shift table
says how far the window may be moved before any pattern could end there, a shift
of zero leads to the bucket of the patterns with that suffix, prefix words weed
the bucket out and a direct comparison confirms the occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from .text import strip_tags, words

#: Most patterns in one broadcast table (about 100 bytes each); larger sets are searched in blocks of this size.
BLOCK = 500_000


class WuManber:
    """Shift and suffix tables of word patterns that all have ``m`` words (m >= 3)."""

    def __init__(self, patterns: Iterable[tuple[tuple[str, ...], object]], m: int):
        self.m = m
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, str], list]] = defaultdict(lambda: defaultdict(list))
        for p, owner in patterns:
            for j in range(1, m):
                block, s = (p[j - 1], p[j]), m - 1 - j
                if self.shift.get(block, m) > s:
                    self.shift[block] = s
            self.bucket[p[-2:]][p[:2]].append((p, owner))
        self.bucket = {k: dict(v) for k, v in self.bucket.items()}

    def search(self, text: list[str]) -> Iterator[tuple[int, object]]:
        """(position of the first word, owner) of every occurrence."""
        m, shift, n = self.m, self.shift, len(text)
        i, far = m - 1, m - 1
        while i < n:
            s = shift.get((text[i - 1], text[i]), far)
            if s:
                i += s
                continue
            at = i - m + 1
            for p, owner in self.bucket[(text[i - 1], text[i])].get((text[at], text[at + 1]), ()):
                if tuple(text[at : i + 1]) == p:
                    yield at, owner
            i += 1


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, fields: list[str], run_words: int = 8,
          block: int = BLOCK) -> DataFrame:
    """``(doc_id, item_id, field, windows, first_word)``: which items each document contains in whole or part.

    A document contains an item if it has at least ``run_words`` consecutive words of one of the
    item's ``fields``; case, punctuation, markup tags and kind of white space do not matter.
    ``windows`` counts the matching runs, ``first_word`` is the first one's word position.  Null and
    short texts match nothing; the windows of repeated documents are added up under their id; without items the result is empty.

    The items are the stated query set.  Their patterns are broadcast in blocks of at most ``block``,
    so a larger set costs further passes over the documents, never a larger broadcast.
    """
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, field string, windows int, first_word int"
    out = None
    patterns: list = []

    def scan(chunk: list) -> DataFrame:
        held = spark.sparkContext.broadcast(chunk)

        def run(batches: Iterable) -> Iterator:
            import pandas as pd

            table = WuManber(held.value, run_words)
            for pdf in batches:
                rows = []
                for d, t in zip(pdf["doc_id"], pdf["text"]):
                    if not t:
                        continue
                    seen: dict = {}
                    for at, owner in table.search(words(strip_tags(t))):
                        hit = seen.setdefault(owner, [0, at])
                        hit[0] += 1
                    rows.extend((d, i, f, n, at) for (i, f), (n, at) in seen.items())
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "field", "windows", "first_word"])

        return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)

    for row in items.select(item_id, *fields).toLocalIterator():  # the stated query set, streamed
        for f in fields:
            w = words(strip_tags(row[f] or ""))
            patterns.extend((tuple(w[i : i + run_words]), (row[item_id], f)) for i in range(len(w) - run_words + 1))
        while len(patterns) >= block:
            part, patterns = patterns[:block], patterns[block:]
            found = scan(part)
            out = found if out is None else out.unionByName(found)
    if out is None or patterns:
        found = scan(patterns)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id", "field").agg(F.sum("windows").cast("int").alias("windows"), F.min("first_word").alias("first_word"))
