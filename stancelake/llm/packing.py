"""Texts of uneven length packed into containers of fixed capacity, in space-filling-curve order.

Every text becomes a hashed word vector, projected to a few dimensions and placed
on a Hilbert curve, so that texts with similar words lie close together.  The
rows are range-partitioned and sorted by the curve's key; along the curve each
block of neighbours is packed by best fit, longest first (inside a block the order along
the curve no longer matters), and what lies in badly
filled containers moves on to the next block.  Blocks are packed independently of
each other in every partition: no global order, no driver.

Lengths are tokens of a public tokenizer.  A text longer than the capacity is cut
into full pieces and a rest; no other text is ever cut.
"""

from __future__ import annotations

import base64
import bisect
import math
import os
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .text import words

#: Folder of the vocabulary files, and the file for each tokenizer name (cl100k_base has no file here;
#: the multilingual byte-level vocabulary stands in for it).
TOKENIZER_DIR = os.environ.get("STANCELAKE_TOKENIZERS", "/opt/tokenizers")
FILES = {"gpt2": "byte_bpe_50k.tiktoken", "cl100k_base": "byte_bpe_multi_50k.tiktoken"}
#: How these vocabularies split text before merging (a fixed value of the tokenizers).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMS, LEVELS, HASHED = 3, 10, 256
BLOCK, CARRY = 4_096, 0.97
#: Documents of a range of the curve (one task).
RANGE = 50_000


@cache
def encoder(path: str):
    """The tokenizer of a vocabulary file (ranks of byte strings)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def hilbert_key(points: np.ndarray, levels: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows of coordinates below 2^levels)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (levels - 1)
    while bit > 1:  # undo the rotations of each level
        low = bit - 1
        for i in range(n):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (levels - 1)
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(levels - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: Iterable[str | None], seed: int = 5) -> np.ndarray:
    """Hilbert keys of texts: hashed word counts, random projection, normal quantiles, curve."""
    import xxhash

    plane = np.random.default_rng(seed).standard_normal((HASHED, DIMS))
    rows = []
    for t in texts:
        h = np.fromiter(map(xxhash.xxh32_intdigest, words(t)), np.uint32)
        v = np.bincount(h % HASHED, np.where(h & np.uint32(0x80000000), 1.0, -1.0), HASHED)
        rows.append(np.sign(v) * np.sqrt(np.abs(v)))
    m = np.array(rows).reshape(-1, HASHED)
    z = m @ plane / np.maximum(np.linalg.norm(m, axis=1), 1e-9)[:, None]
    u = 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(z / math.sqrt(2)))
    return hilbert_key(np.minimum((u * (1 << LEVELS)).astype(np.int64), (1 << LEVELS) - 1), LEVELS)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of items by container: longest first, each into the fullest container that still holds it."""
    rooms: list[tuple[int, int]] = []  # (room left, container), sorted
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, c = rooms.pop(at)
        else:
            room, c = capacity, len(out)
            out.append([])
        out[c].append(i)
        bisect.insort(rooms, (room - sizes[i], c))
    return out


def token_lengths(docs: DataFrame, doc_id: str, text: str, tokenizers: list[str], folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(doc_id, key, lengths array<int>)``: curve key and length by each tokenizer; null texts have length 0."""
    paths = [f"{folder}/{FILES[t]}" for t in tokenizers]

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            lens = [[len(encoder(p).encode_ordinary(t)) for t in texts] for p in paths]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": curve_keys(texts), "lengths": [list(x) for x in zip(*lens)]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, f"doc_id {kind}, key long, lengths array<int>")


def pack(docs: DataFrame, windows: DataFrame, doc_id: str, text: str, folder: str = TOKENIZER_DIR, partitions: int | None = None) -> DataFrame:
    """``(window_id, container_id, doc_id, piece, token_start, tokens)``: every text's place for each window.

    ``windows`` has ``window_id, tokenizer, capacity_tokens``, one row a setting, and each is filled.  Pieces of a text
    are numbered from 0 and cover its tokens from ``token_start`` on without gap.  Null and empty
    texts are one piece of no tokens; repeated documents are placed each; an empty table gives an
    empty result.  Capacities that are null or not positive are refused.
    """
    spark = docs.sparkSession
    wins = [(r["window_id"], r["tokenizer"], r["capacity_tokens"]) for r in windows.select("window_id", "tokenizer", "capacity_tokens").collect()]  # the settings
    for _, t, c in wins:
        if not c or c <= 0 or t not in FILES:
            raise ValueError(f"no such window: {t} of {c} tokens")
    names = sorted({t for _, t, _ in wins})
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"window_id int, container_id long, doc_id {kind}, piece int, token_start int, tokens int"
    if not wins:
        return spark.createDataFrame([], schema)
    sized = materialize(token_lengths(docs, doc_id, text, names, folder), "pack-sized")  # the range sort reads it twice
    count = sized.count()
    n = partitions or max(math.ceil(count / RANGE), min(spark.sparkContext.defaultParallelism, math.ceil(count / BLOCK)), 1)
    ordered = sized.repartitionByRange(n, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    plan = [(w, names.index(t), c) for w, t, c in wins]

    def run(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        waiting: dict = {w: [] for w, _, _ in plan}
        made: dict = {w: 0 for w, _, _ in plan}

        def place(w: int, capacity: int, last: bool) -> list[tuple]:
            items = waiting[w]
            bins = best_fit([x[3] for x in items], capacity)
            rows, keep = [], []
            for b in bins:
                if not last and sum(items[i][3] for i in b) < CARRY * capacity and len(keep) < BLOCK // 2:
                    keep.extend(b)
                    continue
                rows.extend((w, base + made[w], *items[i]) for i in b)
                made[w] += 1
            waiting[w] = [items[i] for i in sorted(keep)]
            return rows

        cols = ["window_id", "container_id", "doc_id", "piece", "token_start", "tokens"]
        for pdf in batches:
            for d, lens in zip(pdf["doc_id"], pdf["lengths"]):
                for w, k, c in plan:
                    size = int(lens[k])
                    for p in range(max(1, -(-size // c))):
                        waiting[w].append((d, p, p * c, min(c, size - p * c)))
            rows = [r for w, _, c in plan if len(waiting[w]) >= BLOCK for r in place(w, c, False)]
            if rows:
                yield pd.DataFrame(rows, columns=cols)
        rows = [r for w, _, c in plan if waiting[w] for r in place(w, c, True)]
        yield pd.DataFrame(rows, columns=cols)

    return ordered.mapInPandas(run, schema)
