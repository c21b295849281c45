"""Near-duplicate texts: exact set-similarity join by T-occurrence search (DivideSkip).

A text is the set of its word runs (shingles); every shingle has an inverted list.
Two sets of m and n shingles and Jaccard similarity t or more share at least
``T = ceil(t / (1 + t) * (m + n))``.  DivideSkip sets the L longest lists of a text
aside, L = ceil(t * n) / (mu * ln(longest list) + 1), and leaves ``need`` of them; a
pair must then meet ``need`` times among the ``n - T + need`` shortest lists of either.
That stretch depends on both sizes: half of the lists for the smallest partner, a third
for one of the same size, so an entry meets only partners whose size leaves its place in
the order inside.  The short lists are merged inside token groups, the counts of a pair
are added up over the groups, and pairs short of ``need`` end there.  The rest is
probed in the long lists by binary search.  A parity bitmap of each set, which bounds
the overlap from above without error, keeps hopeless pairs inside their group.
Nothing is sampled or capped: the order of the lists decides only how much work there
is, never which pairs are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..session import materialize

#: Entries of the broadcast table of the most frequent shingles (16 bytes each).  Any order of the
#: lists is exact, so shingles outside the table are simply taken as rare.
FREQUENT = 200_000
#: Postings and pairs of postings that one token group aims at, pairs compared at a time, and the length beyond which a list is split among groups.
GROUP_POSTINGS, GROUP_PAIRS, CHUNK_PAIRS = 400_000, 400_000_000, 32_768
LONG_LIST = 32_768
#: Partners in one list from which on an entry is compared with them as a block; texts that the number of groups is reckoned from.
BLOCK, SAMPLE = 256, 2_000
#: Words of a bitmap that are compared at once.
WORDS = 8
#: DivideSkip's weight of the merge against the probes (a fixed value of the method).
MU = 0.0085
WORD_RUN = r"[\p{L}\p{N}]+"


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, run: int) -> tuple[DataFrame, DataFrame]:
    """``members (id, key)`` and ``sets (key, sh, n)`` of all distinct texts; written to shared storage.

    ``key`` is the signature of the words.  Texts shorter than ``run`` words have no set.
    """
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    w = F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("text"), w.alias("words")).where(F.size("words") >= run)
    base = base.withColumn("key", F.md5(F.concat_ws(" ", "words").cast("binary")))
    members = materialize(base.select("id", "key").distinct(), "dup-members")
    # one text of each key, chosen before the shingles are made; the text travels, not its words
    one = base.select("key", "text").groupBy("key").agg(F.any_value("text").alias("text")).select("key", F.regexp_extract_all("text", F.lit(WORD_RUN), F.lit(0)).alias("words"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - (run - 1)), lambda i: F.xxhash64(*[F.element_at("words", i + j) for j in range(run)])))
    sets = one.select("key", F.sort_array(runs).alias("sh"))
    return members, materialize(sets.select("key", "sh", F.size("sh").alias("n")), "dup-sets")


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """``(key_a, key_b, shared, similarity)`` with key_a < key_b: all pairs of sets of at least that Jaccard similarity."""
    spark = sets.sparkSession
    stats = sets.agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.percentile_approx("n", 0.9).alias("p90")).first()
    total = stats["n"] or 0
    bits = int(np.clip(2 ** math.ceil(math.log2(max(3 * (stats["p90"] or 1), 2))), 512, 8192))
    lists = sets.select(F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 2")
    common = lists.orderBy(F.desc("df"), "s").limit(FREQUENT).toPandas()  # at most FREQUENT rows
    common = common.sort_values("s")
    df = common["df"].to_numpy(np.int64)
    groups = _groups(sets, stats["docs"], total, threshold, common["s"].to_numpy(np.int64), df)
    held = spark.sparkContext.broadcast((common["s"].to_numpy(np.int64), df))
    routed = sets.mapInArrow(_router(held, threshold, bits, groups), _ROUTED)
    part = routed.groupBy("g").applyInArrow(_merger(threshold), "key_a string, key_b string, need int, c int")
    cand = materialize(part.groupBy("key_a", "key_b", "need").agg(F.sum("c").cast("int").alias("c")).where("c >= need"), "dup-candidates")
    # only sets of a candidate travel to be probed
    live = cand.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    some = materialize(sets.join(live, "key", "left_semi"), "dup-probed")
    a = some.select(F.col("key").alias("key_a"), F.col("sh").alias("sh_a"))
    b = some.select(F.col("key").alias("key_b"), F.col("sh").alias("sh_b"))
    met = cand.join(a, "key_a").join(b, "key_b")
    return met.select("key_a", "key_b", "need", "c", "sh_a", "sh_b").mapInArrow(_prober(held, threshold), "key_a string, key_b string, shared int, similarity double")


def _groups(sets: DataFrame, docs: int, total: int, t: float, known: np.ndarray, df: np.ndarray) -> int:
    """How many token groups keep the postings and the pairs of one group near their aims, reckoned from some texts; results don't depend on it."""
    share = min(1.0, SAMPLE / max(docs, 1))
    some = sets.where(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") < share * 2.0**32).select("sh").toPandas()["sh"]
    pairs = 0.0
    for x in some:
        f = np.sort(_lengths(known, df, np.asarray(x)))
        short = int(divide(np.array([len(f)]), f[-1:], t)[0][0])
        pairs += float(f[:short].sum()) / 4  # about half of a list's entries are short ones, and each pair is met from one side
    return max(8, math.ceil(total * (1 - t) / GROUP_POSTINGS), math.ceil(pairs / share / GROUP_PAIRS))


def divide(n: np.ndarray, longest: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip's division of sets of ``n`` lists: how many are short, and in how many of those a partner must be."""
    need = np.ceil(t * n - 1e-9).astype(np.int64)
    aside = np.minimum((need / (MU * np.log(np.maximum(longest, 1)) + 1)).astype(np.int64), need - 1)
    return n - aside, need - aside


def least_shared(m: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    """T of two sets of ``m`` and ``n`` shingles."""
    return np.ceil((m + n) * (t / (1 + t)) - 1e-9).astype(np.int64)


def _lengths(known: np.ndarray, df: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lengths of the lists of the shingles ``x``; those outside the table count as 0."""
    if not len(known):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, df[at], 0)


def _mix(x: np.ndarray, c: int = 0) -> np.ndarray:
    """A second hash of 64-bit values."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (c + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bitmaps(sh: np.ndarray, doc: np.ndarray, docs: int, bits: int) -> np.ndarray:
    """Parity bitmaps of sets: bits set an odd number of times; the distance of two bitmaps is at most the sets' difference."""
    out = []
    at = (_mix(sh) & np.uint64(bits - 1)).astype(np.int64)
    step = max(1, 4_000_000 // bits)
    for a in range(0, docs, step):
        b = min(a + step, docs)
        lo, hi = np.searchsorted(doc, [a, b])
        odd = np.bincount((doc[lo:hi] - a) * bits + at[lo:hi], minlength=(b - a) * bits) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(b - a, bits), axis=1))
    return np.concatenate(out) if out else np.empty((0, bits // 8), np.uint8)


def bitmap(sh: np.ndarray, bits: int) -> np.ndarray:
    """The parity bitmap of one set."""
    return bitmaps(sh, np.zeros(len(sh), np.int64), 1, bits)[0]


_ROUTED = "g int, keys binary, n binary, need binary, images binary, tok binary, doc binary, pos binary, role binary"


def _router(held, t: float, bits: int, groups: int):
    """One message a batch and token group: its texts (key, size, need, bitmap) and its postings (list, text, place in the text's order, role)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        known, df = held.value
        for batch in batches:
            keys = np.frombuffer(bytes.fromhex("".join(batch["key"].to_pylist())), ">u8").reshape(-1, 2)
            col = batch["sh"]
            x = np.asarray(col.flatten())
            n = np.diff(np.asarray(col.offsets)).astype(np.int64)
            doc = np.repeat(np.arange(len(n)), n)
            images = bitmaps(x, doc, len(n), bits)
            f = _lengths(known, df, x)
            o = np.lexsort((x, f, doc))
            first = np.cumsum(n) - n
            short, need = divide(n, f[o][first + n - 1], t)  # the longest list comes last
            place = np.arange(len(x)) - np.repeat(first, n)
            ok = place < np.repeat(short, n)
            o, place = o[ok], place[ok].astype(np.int32)
            tok, d, f = x[o], doc[o], f[o]
            role = np.zeros(len(tok), np.uint8)
            c = -(-f // LONG_LIST)
            if (c > 1).any():  # a long list is cut into chunks of texts, and every two chunks meet in one list
                split = np.flatnonzero(c > 1)
                k = c[split]
                own = (keys[:, 0] >> np.uint64(16)).astype(np.int64)[d[split]] % k
                row, mine = np.repeat(split, k), np.repeat(own, k)
                j = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                pair = np.minimum(j, mine) * np.repeat(k, k) + np.maximum(j, mine)
                some = _mix(tok[row], 3).view(np.int64) ^ _mix(pair, 5).view(np.int64)
                rest = np.flatnonzero(c <= 1)
                place = np.concatenate([place[rest], place[row]])
                tok, d, role = np.concatenate([tok[rest], some]), np.concatenate([d[rest], d[row]]), np.concatenate([role[rest], np.where(j == mine, 0, np.where(mine < j, 1, 2)).astype(np.uint8)])
            g = (_mix(tok, 7) % np.uint64(groups)).astype(np.int64)
            o = np.lexsort((d, g))
            g, tok, d, place, role = g[o], tok[o], d[o], place[o], role[o]
            cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
            rows: list[tuple] = []
            for a, b in zip(cut, np.append(cut[1:], len(g))):
                who, local = np.unique(d[a:b], return_inverse=True)
                rows.append((int(g[a]), keys[who].tobytes(), n[who].astype(np.int32).tobytes(), need[who].astype(np.int32).tobytes(), images[who].tobytes(), tok[a:b].tobytes(), local.astype(np.int32).tobytes(), place[a:b].tobytes(), role[a:b].tobytes()))
            cols = list(zip(*rows)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(v, pa.binary()) for v in cols[1:]]], names=["g", "keys", "n", "need", "images", "tok", "doc", "pos", "role"])

    return run


def _merger(t: float):
    """Merge the short lists of one token group: pairs with the number of lists they share, where their bitmaps allow enough overlap."""

    def run(table):
        import pyarrow as pa

        def column(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table[name].to_pylist()), kind)

        keys, n, need = column("keys", ">u8").astype(np.uint64).reshape(-1, 2), column("n", np.int32).astype(np.int64), column("need", np.int32).astype(np.int64)
        tok, pos, role = column("tok", np.int64), column("pos", np.int32).astype(np.int64), column("role", np.uint8)
        many_docs = [len(x) // 4 for x in table["n"].to_pylist()]
        doc = np.concatenate([np.frombuffer(x, np.int32).astype(np.int64) + a for x, a in zip(table["doc"].to_pylist(), np.cumsum([0, *many_docs]))])
        image = column("images", np.uint64).reshape(len(keys), -1, WORDS)
        # texts by size: of a list, only the stretch of fitting sizes before an entry can hold a partner
        o = np.lexsort((keys[:, 1], keys[:, 0], n))
        place = np.empty(len(o), np.int64)
        place[o] = np.arange(len(o))
        keys, n, need, image, doc = keys[o], n[o], need[o], image[o], place[doc]
        share = (1 - t) / (1 + t)

        def apart(d: np.ndarray) -> np.ndarray:
            """Bits set in each row of WORDS words: their counts are bytes of one word, added up in four lanes of 16 bits."""
            v = np.bitwise_count(d).view(np.uint64).ravel()
            v = (v & np.uint64(0x00FF00FF00FF00FF)) + ((v >> np.uint64(8)) & np.uint64(0x00FF00FF00FF00FF))
            return (v * np.uint64(0x0001000100010001)) >> np.uint64(48)

        o = np.lexsort((doc, tok))  # every list is a run of ascending texts
        tok, doc, pos, role = tok[o], doc[o], pos[o], role[o]
        cut = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
        begin = np.repeat(cut, np.diff(np.append(cut, len(tok))))
        size = n[doc]
        # entries whose place is inside for a partner of their size or more; each entry meets those before it whose size leaves its own place inside
        held = np.flatnonzero(pos < size - least_shared(size, size, t) + need[doc])
        before = np.cumsum(np.bincount(held, minlength=len(tok))) - np.bincount(held, minlength=len(tok))
        most = np.floor((size - pos + need[doc] - 1 + 1e-6) * ((1 + t) / t)).astype(np.int64) - size
        least = np.ceil(t * size - 1e-9).astype(np.int64)
        wide = int(size.max()) + 2
        order = (begin * wide + size)[held]
        rank = np.searchsorted(order, begin * wide + least)
        many = np.maximum(np.minimum(before, np.searchsorted(order, begin * wide + np.clip(most, 0, size), "right")) - rank, 0)
        near = image[doc[held], 0]
        large = n[doc[held]] * share + 1e-6
        found: list[np.ndarray] = []

        def keep(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> None:
            """Of entries whose first words fit: roles, places, the rest of the bitmaps."""
            r = role[x] + role[y]
            i, j = doc[x], doc[y]
            ok = ((r == 0) | (r == 3)) & (i != j)
            short = np.minimum(need[i], need[j]) - least_shared(n[i], n[j], t)
            ok &= (pos[x] < n[i] + short) & (pos[y] < n[j] + short)
            i, j, far = i[ok], j[ok], far[ok]
            for w in range(1, image.shape[1]):
                far = far + apart(image[i, w] ^ image[j, w])
                ok = far <= (n[i] + n[j]) * share + 1e-6
                i, j, far = i[ok], j[ok], far[ok]
            found.append(i * len(keys) + j)

        # entries with many partners: a block of neighbours in memory each
        for x in np.flatnonzero(many >= BLOCK):
            for a in range(rank[x], rank[x] + many[x], CHUNK_PAIRS):
                b = min(a + CHUNK_PAIRS, rank[x] + many[x])
                far = apart(near[a:b] ^ image[doc[x], 0])
                y = np.flatnonzero(far <= large[a:b] + size[x] * share)
                if len(y):
                    keep(np.full(len(y), x), held[y + a], far[y])
        # the others together
        by = np.flatnonzero((many > 0) & (many < BLOCK))
        work = np.cumsum(many[by])
        a = 0
        while a < len(by):
            b = max(int(np.searchsorted(work, (work[a - 1] if a else 0) + CHUNK_PAIRS, "right")), a + 1)
            p = by[a:b]
            k = many[p]
            x = np.repeat(p, k)
            y = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(rank[p], k)
            far = apart(np.repeat(image[doc[p], 0], k, axis=0) ^ near[y])
            ok = far <= large[y] + size[x] * share
            keep(x[ok], held[y[ok]], far[ok])
            a = b
        pair, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        x, y = pair // max(len(keys), 1), pair % max(len(keys), 1)
        turn = (keys[x, 0] > keys[y, 0]) | (keys[x, 0] == keys[y, 0]) & (keys[x, 1] > keys[y, 1])
        first, second = np.where(turn, y, x), np.where(turn, x, y)
        text = lambda at: pa.array([keys[i].astype(">u8").tobytes().hex() for i in at], pa.string())
        return pa.table({"key_a": text(first), "key_b": text(second), "need": pa.array(np.minimum(need[x], need[y]), pa.int32()), "c": pa.array(c, pa.int32())})

    return run


def _prober(held, t: float):
    """Look up the lists set aside by binary search and keep the pairs that share enough."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        known, df = held.value

        def rarest(x: np.ndarray) -> np.ndarray:
            return x[np.lexsort((x, _lengths(known, df, x)))]

        def within(x: np.ndarray, y: np.ndarray) -> int:
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            return int((y[at] == x).sum())

        for batch in batches:
            shared, sim = [], []
            for need, c, x, y in zip(batch["need"].to_pylist(), batch["c"].to_pylist(), batch["sh_a"], batch["sh_b"]):
                x, y = np.asarray(x.values), np.asarray(y.values)
                short = need - int(least_shared(len(x), len(y), t))
                xo, yo = rarest(x), rarest(y)
                # the merge counted short with short; the long lists of one side are probed in all of the other, those of the other in the short ones
                both = c + within(xo[len(x) + short :], y) + within(yo[len(y) + short :], np.sort(xo[: len(x) + short]))
                shared.append(both)
                sim.append(both / (len(x) + len(y) - both))
            ok = np.array(sim) >= t - 1e-12 if sim else np.empty(0, bool)
            rows = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [batch["key_a"].take(pa.array(rows)), batch["key_b"].take(pa.array(rows)), pa.array(np.array(shared, np.int32)[rows]), pa.array(np.array(sim, float)[rows])],
                names=["key_a", "key_b", "shared", "similarity"])

    return run


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, run: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """``members (id, key)`` and ``links (key_a, key_b, shared, similarity)`` between distinct texts.

    ``run`` is the number of words of a shingle.  Copies with the same words share a key and need no
    link.  Null, empty and too short texts have no shingles and are in no class; repeated rows count
    once; an empty table gives empty results.
    """
    members, sets = shingle_sets(docs, id_col, text_col, run)
    return members, materialize(similar_pairs(sets, threshold), "dup-links")


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id, class_key, group_id, links)``: one row per document; ``group_id`` is the smallest id of its group.

    ``links`` counts the other distinct texts its own text is linked with.
    """
    comp = connected_components(links, "key_a", "key_b").withColumnsRenamed({"vertex": "key", "component": "root"})
    deg = links.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    full = members.join(comp, "key", "left").join(deg, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = full.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("size"))
    return full.join(names, "root").select("id", F.col("key").alias("class_key"), "group_id", F.coalesce("links", F.lit(0)).alias("links"), "size")


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b: pairs of ids whose texts are the same or linked."""
    own = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    pairs = links.select("key_a", "key_b").unionByName(own)
    a = members.select(F.col("id").alias("a"), F.col("key").alias("key_a"))
    b = members.select(F.col("id").alias("b"), F.col("key").alias("key_b"))
    both = pairs.join(a, "key_a").join(b, "key_b").where("a <> b")
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
