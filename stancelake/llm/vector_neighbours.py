"""The k most similar vectors of every vector: multi-probe p-stable hashing.

``h_j(v) = floor((a_j . v + b_j) / w)`` with Gaussian ``a_j`` and ``b_j`` uniform in
[0, w) are the coordinates of a vector's bucket.  A query visits its own bucket and
then the perturbed ones in the order of their estimated success (the sum of squared
distances to the crossed boundaries), in each of several independent tables; the
candidates of all tables are merged and reranked by their exact cosine.  The width is
fitted to the distances in a bounded sample.

Layout (layered hashing): an outer hash of the same kind with few coordinates names a
part, and a part is one task.  A vector is sent to its own part once and, as a query,
to the parts across the boundaries it is near, in the order of their success; all
tables live inside the parts, so neither tables nor probes move data.  The rows of one
batch for one part travel as one message, as float16 where that is lossless and as
float32 otherwise.  Equal vectors are searched once.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

#: Bytes of vectors (as float32) that a part aims at, and rows of a bucket.
PART_BYTES = 50_000_000
CELL_ROWS = 64
#: Most rows of the sample from which the width is fitted and hot parts are foreseen; every row is indexed all the same.
SAMPLE_ROWS = 20_000
#: Tables inside a part, width in units of the neighbours' distance, and most parts a query is sent to.
TABLES, WIDTH, MAX_PARTS = 2, 5.0, 4
#: Bits by which one coordinate of that width tells two unrelated vectors apart.
BITS = 0.75
SIDE = 8_192


def probes_for(bits: int) -> int:
    """Buckets to visit in each table so that recall holds as coordinates are added: 32 up to 10 of them, twice as many for every 3 more."""
    return math.ceil(32 * 2 ** (max(bits - 10, 0) / 3))


@dataclass(frozen=True)
class Hash:
    """One p-stable hash: coordinates, width and seed."""

    size: int
    width: float
    seed: tuple[int, ...]

    def coordinates(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket coordinates and the position inside the bucket (0 to 1)."""
        r = np.random.default_rng([*self.seed, unit.shape[1]])
        plane = r.standard_normal((unit.shape[1], self.size)).astype(np.float32)
        z = (unit @ plane + r.uniform(0, self.width, self.size).astype(np.float32)) / np.float32(self.width)
        h = np.floor(z)
        return h.astype(np.int64), z - h

    @property
    def factors(self) -> np.ndarray:
        return np.random.default_rng([*self.seed, 1]).integers(-(2**62), 2**62, self.size, dtype=np.int64) | 1

    def code(self, h: np.ndarray) -> np.ndarray:
        """64-bit code of a bucket; a step along a coordinate adds that coordinate's factor."""
        with np.errstate(over="ignore"):
            return (h * self.factors).sum(axis=-1)

    def visits(self, h: np.ndarray, inside: np.ndarray, probes: int, reach: float = np.inf) -> np.ndarray:
        """Codes of the buckets to visit by estimated success, the own one included, sorted; (rows, probes).

        Boundaries further than ``reach`` widths are not crossed; missing visits repeat the own bucket.
        """
        n, m = h.shape
        home = self.code(h)
        if not m:
            return home[:, None]
        score = np.concatenate([inside**2, (1 - inside) ** 2], axis=1)
        # the 8 nearest boundaries, and more where they give too few perturbations
        top = next((t for t in range(min(8, 2 * m), 2 * m) if sum(math.comb(t, k) for k in range(5)) >= probes), 2 * m)
        order = np.argsort(score, axis=1)[:, :top]
        s = np.take_along_axis(score, order, 1).astype(np.float32)
        axis = order % m
        step = np.where(order < m, -1, 1) * self.factors[axis]
        sets = [c for k in range(min(top, 4 if top > 6 else top) + 1) for c in itertools.combinations(range(top), k)]
        ind = np.zeros((top, len(sets)), np.float32)
        for j, c in enumerate(sets):
            ind[list(c), j] = 1
        total = s @ ind
        # both directions of one coordinate cancel out to a bucket that is visited anyway
        pair = [[j for j, c in enumerate(sets) if x in c and y in c] for x, y in itertools.combinations(range(top), 2)]
        for (x, y), js in zip(itertools.combinations(range(top), 2), pair):
            same = np.flatnonzero(axis[:, x] == axis[:, y])
            if len(same) and js:
                total[np.ix_(same, js)] = np.inf
        want = min(probes, len(sets))
        best = np.argpartition(total, want - 1, axis=1)[:, :want] if want < len(sets) else np.tile(np.arange(len(sets)), (n, 1))
        with np.errstate(over="ignore"):
            codes = home[:, None] + np.take_along_axis(step @ ind.astype(np.int64), best, 1)
        bad = np.take_along_axis(total, best, 1) > reach * reach
        bad |= np.isinf(np.take_along_axis(total, best, 1))
        codes[bad] = np.broadcast_to(home[:, None], codes.shape)[bad]
        return np.sort(codes, axis=1)


@dataclass(frozen=True)
class Index:
    """The outer hash, the reach of a query over its boundaries, the inner hashes of the tables and the extra salting of hot parts."""

    outer: Hash
    reach: float
    tables: tuple[Hash, ...]
    probes: int
    splits: dict[tuple[str, int, int], int] = field(default_factory=dict)

    def parts(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own part of every row, and the parts it visits (sorted, with repetitions)."""
        h, inside = self.outer.coordinates(unit)
        return self.outer.code(h), self.outer.visits(h, inside, MAX_PARTS, self.reach)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / n[:, None]).astype(np.float32)


def _by_dim(batch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(model, ids, vectors) of the usable rows of an Arrow batch, by model and dimension."""
    import pyarrow as pa
    import pyarrow.compute as pc

    t = pa.Table.from_batches([batch]).combine_chunks()
    t = t.filter(pc.and_(t["vec"].is_valid(), t["id"].is_valid()))
    if not t.num_rows:
        return
    size = pc.list_value_length(t["vec"])
    for model in pc.unique(t["model"]).to_pylist():
        for dim in pc.unique(size).to_pylist():
            if not dim:
                continue
            sub = t.filter(pc.and_(pc.equal(t["model"], model), pc.equal(size, dim))).combine_chunks()
            if not sub.num_rows:
                continue
            v = sub["vec"].chunk(0)
            flat = v.flatten()
            x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float32).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            if ok.any():
                yield model, np.asarray(sub["id"].to_numpy())[ok], x[ok]


def _packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows float16 holds without loss, and the rows as float16."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    return (half.astype(np.float32) == x).all(axis=1), half


_ROUTED = "model string, dim int, part long, salt int, half boolean, ids binary, home binary, blob binary"
_FOUND = "model string, id long, other long, similarity double"


def fitted(sample: np.ndarray, k: int, min_similarity: float | None) -> float:
    """The distance between unit vectors that neighbours are expected within.

    Given a least similarity it is that similarity's distance; otherwise the median distance of some
    rows of the sample to their k-th neighbour there, which is no less than in the whole table.
    """
    if min_similarity is not None and min_similarity < 1:
        return math.sqrt(2 - 2 * max(min_similarity, 0.0))
    if len(sample) <= k:
        return 1.0
    q = sample[:: max(1, len(sample) // 512)]
    s = np.sort(q @ sample.T, axis=1)[:, -min(k + 1, len(sample))]
    return float(np.clip(np.median(np.sqrt(np.maximum(2 - 2 * s, 0))), 0.2, 1.2))


def nearest(vectors: DataFrame, k: int = 5, min_similarity: float | None = None, probes: int | None = None,
            cell_rows: int = CELL_ROWS, part_rows: int | None = None, tables: int = TABLES, width: float | None = None, seed: int = 11,
            query_modulus: int = 1, total: int | None = None) -> DataFrame:
    """``(model, id, other, similarity, rank)``: up to k nearest rows of every query row, by cosine.

    ``vectors`` has ``model, id, vec array<float>``.  Queries are the rows whose id is divisible by
    ``query_modulus``; all rows are indexed.  ``min_similarity`` (inclusive, checked in double) drops
    weaker neighbours early.  Without ``probes`` their number grows with the part (``probes_for``).  Null, empty, all-zero and non-finite vectors take no part, vectors of
    different length are never compared, equal similarities are ranked by smaller id, an empty table
    gives an empty result.  A part foreseen to be hot is split among several tasks, its queries going
    to each of them, so that no task holds an unbounded group and nothing is dropped.
    """
    spark = vectors.sparkSession
    counts = {r["model"]: r["n"] for r in vectors.where("vec is not null").groupBy("model").agg(F.count("*").alias("n")).collect()}  # one row a model
    n, most = sum(counts.values()), max(counts.values(), default=0)
    if total is not None:
        n = most = total
    frac = min(1.0, SAMPLE_ROWS / max(sum(counts.values()), 1))
    drawn = vectors.select("model", "id", "vec").where("vec is not null").sample(frac, seed).limit(SAMPLE_ROWS).toArrow()  # at most SAMPLE_ROWS rows
    seen = [(m, _unit(x)) for b in drawn.combine_chunks().to_batches() for m, _, x in _by_dim(b)]
    largest = max((u for _, u in seen), key=len, default=np.zeros((0, 1), np.float32))
    near = fitted(largest[:4_096], k, min_similarity)
    wide = WIDTH * near if width is None else width
    rows = part_rows or PART_BYTES // (4 * max((u.shape[1] for _, u in seen), default=1))
    outer = Hash(max(math.ceil(math.log2(max(most, 1) / rows) / BITS), 0) if most > rows else 0, wide, (seed, 0))
    bits = max(math.ceil(math.log2(max(min(most, rows), 1) / cell_rows)), 0)  # a table no larger than a bucket is one
    size = min(math.ceil(bits / BITS), 48)
    probes = probes_for(bits) if probes is None else probes
    index = Index(outer, near / wide, tuple(Hash(size, wide, (seed, 1 + t)) for t in range(tables)), probes)
    if outer.size:
        share: dict[tuple[str, int, int], int] = {}
        for m, u in seen:
            code, c = np.unique(outer.code(outer.coordinates(u)[0]), return_counts=True)
            for x, y in zip(code, c):
                share[m, u.shape[1], int(x)] = share.get((m, u.shape[1], int(x)), 0) + int(y)
        splits = {key: math.ceil(c / frac / rows) for key, c in share.items() if c / frac > 2 * rows}
        index = Index(outer, index.reach, index.tables, probes, splits)
    routed = vectors.select("model", F.col("id").cast("long").alias("id"), "vec").mapInArrow(_router(index, query_modulus), _ROUTED)
    found = routed.groupBy("model", "dim", "part", "salt").applyInArrow(_searcher(index, k, min_similarity, query_modulus), _FOUND)
    w = Window.partitionBy("model", "id").orderBy(F.desc("similarity"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _router(index: Index, modulus: int):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: dict[str, list] = {c: [] for c in ("model", "dim", "part", "salt", "half", "ids", "home", "blob")}
            for model, ids, x in _by_dim(b):
                home, parts = index.parts(_unit(x))
                ask = np.flatnonzero(ids % modulus == 0)
                far = np.concatenate([np.ones((len(ask), 1), bool), parts[ask, 1:] != parts[ask, :-1]], axis=1)
                qrow, col = np.nonzero(far)
                qpart = parts[ask][qrow, col]
                qrow = ask[qrow]
                away = qpart != home[qrow]
                row = np.concatenate([np.arange(len(ids)), qrow[away]])
                part = np.concatenate([home, qpart[away]])
                at_home = np.arange(len(row)) < len(ids)
                salt = np.zeros(len(row), np.int64)
                if index.splits:
                    split = np.array([index.splits.get((model, x.shape[1], int(p)), 1) for p in part])
                    pick = np.repeat(np.arange(len(row)), split)
                    salt = np.arange(len(pick)) - np.repeat(np.cumsum(split) - split, split)
                    row, part, at_home = row[pick], part[pick], at_home[pick]
                    at_home &= salt == ids[row] % split[pick]
                    use = at_home | (ids[row] % modulus == 0)
                    row, part, at_home, salt = row[use], part[use], at_home[use], salt[use]
                same, half = _packed(x)
                o = np.lexsort((same[row], salt, part))
                row, part, salt, at_home = row[o], part[o], salt[o], at_home[o]
                kind = same[row]
                new = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1]))) if len(row) else []
                for a, z in zip(new, np.append(new[1:], len(row))):
                    r = row[a:z]
                    for c, v in zip(out, (model, x.shape[1], int(part[a]), int(salt[a]), bool(kind[a]), ids[r].astype(np.int64).tobytes(), at_home[a:z].tobytes(), (half if kind[a] else x)[r].tobytes())):
                        out[c].append(v)
            types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, types)], names=list(out))

    return run


def _groups(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the equal vectors' group of every row, and the rows ordered by group and id."""
    word = np.ascontiguousarray(x).view(np.uint32).astype(np.uint64)
    mul = np.random.default_rng(5).integers(1, 2**63, size=(2, x.shape[1]), dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        sig = np.stack([(word * m).sum(axis=1, dtype=np.uint64) for m in mul], axis=1)
    o = np.lexsort((ids, sig[:, 1], sig[:, 0]))
    new = np.append(False, (sig[o][1:] != sig[o][:-1]).any(axis=1))
    group = np.empty(len(ids), np.int64)
    group[o] = np.cumsum(new)
    return group, o


def _searcher(index: Index, k: int, least: float | None, modulus: int):
    def run(key, table):
        import pyarrow as pa

        model, dim = key[0].as_py(), key[1].as_py()
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int64)
        home = np.frombuffer(b"".join(table["home"].to_pylist()), bool)
        raw = np.concatenate([np.frombuffer(x, np.float16 if h else np.float32).reshape(-1, dim).astype(np.float32) for x, h in zip(table["blob"].to_pylist(), table["half"].to_pylist())])
        group, o = _groups(raw, ids)
        first = np.flatnonzero(np.append(True, group[o][1:] != group[o][:-1]))
        rep = o[first]  # one row a group of equal vectors
        # of equal vectors the k + 2 smallest ids are indexed: no query needs more of them
        at = home[o].astype(np.int64)
        before = np.cumsum(at) - at
        nth = before - np.repeat(before[first], np.diff(np.append(first, len(o))))
        hrow = o[(at > 0) & (nth < k + 2)]
        asked = ids % modulus == 0
        ask = rep[np.bincount(group[asked], minlength=len(rep))[: len(rep)] > 0]
        unit = _unit(raw)
        floor = -2.0 if least is None else least - 1e-4
        kept, held = [], 0
        for t in index.tables:
            h, inside = t.coordinates(unit)
            code = t.code(h)
            inner = hrow[np.argsort(code[hrow], kind="stable")]
            hcode, start = np.unique(code[inner], return_index=True)
            stop = np.append(start[1:], len(inner))
            if not len(hcode):
                break
            qrow, qcell = [], []
            for a in range(0, len(ask), SIDE):
                some = ask[a : a + SIDE]
                cells = t.visits(h[some], inside[some], index.probes)
                ok = np.ones(cells.shape, bool)
                ok[:, 1:] = cells[:, 1:] != cells[:, :-1]
                i, j = np.nonzero(ok)
                at_ = np.minimum(np.searchsorted(hcode, cells[i, j]), len(hcode) - 1)
                there = hcode[at_] == cells[i, j]
                qrow.append(some[i[there]].astype(np.int32))
                qcell.append(at_[there].astype(np.int32))
            qrow, qcell = (np.concatenate(qrow), np.concatenate(qcell)) if qrow else (np.empty(0, np.int32),) * 2
            o2 = np.argsort(qcell, kind="stable")
            qrow, qcell = qrow[o2], qcell[o2]
            lo = np.searchsorted(qcell, np.arange(len(hcode)), "left")
            hi = np.searchsorted(qcell, np.arange(len(hcode)), "right")
            for c in np.flatnonzero(hi > lo):
                hs_all, qs_all = inner[start[c] : stop[c]], qrow[lo[c] : hi[c]]
                for a in range(0, len(qs_all), SIDE):
                    qs = qs_all[a : a + SIDE]
                    for b in range(0, len(hs_all), SIDE):
                        hs = hs_all[b : b + SIDE]
                        s = unit[qs] @ unit[hs].T
                        if least is None and s.shape[1] > k + 2:
                            top = np.argpartition(-s, k + 1, axis=1)[:, : k + 2]
                            i, j = np.repeat(np.arange(len(qs)), k + 2), top.ravel()
                        else:
                            i, j = np.nonzero(s >= floor)
                        kept.append((qs[i], hs[j], s[i, j]))
                        held += len(i)
                        if held > 2_000_000:
                            kept = [_best(*(np.concatenate(x) for x in zip(*kept)), ids, k)]
                            held = len(kept[0][0])
        q, h, _ = _best(*(np.concatenate(x) for x in zip(*kept)), ids, k) if kept else (np.empty(0, np.int64),) * 3
        exact = np.empty(len(q))
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw, dtype=np.float64))
        for a in range(0, len(q), 65_536):
            qq, hh = q[a : a + 65_536], h[a : a + 65_536]
            exact[a : a + 65_536] = np.where(group[qq] == group[hh], 1.0, np.einsum("ij,ij->i", raw[qq], raw[hh], dtype=np.float64) / (norm[qq] * norm[hh]))
        exact = np.round(exact, 12)  # multiples of one vector are equally similar
        if least is not None:
            ok = exact >= least
            q, h, exact = q[ok], h[ok], exact[ok]
        # every asked row takes the list of its group, without itself
        o3 = np.lexsort((ids[h], -exact, group[q])) if len(q) else np.empty(0, np.int64)
        gq, h, exact = group[q][o3], h[o3], exact[o3]
        begin = np.searchsorted(gq, group[asked], "left")
        many = np.searchsorted(gq, group[asked], "right") - begin
        who = np.repeat(np.flatnonzero(asked), many)
        at3 = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        ok = ids[who] != ids[h[at3]]
        who, at3 = who[ok], at3[ok]
        return pa.table({"model": pa.array([model] * len(who), pa.string()), "id": pa.array(ids[who], pa.int64()), "other": pa.array(ids[h[at3]], pa.int64()), "similarity": pa.array(exact[at3], pa.float64())})

    return run


def _best(q: np.ndarray, h: np.ndarray, s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the k + 2 most similar rows (itself, and one to spare for rounding), each once."""
    _, one = np.unique(q.astype(np.int64) * len(ids) + h, return_index=True)
    q, h, s = q[one], h[one], s[one]
    o = np.lexsort((ids[h], -s, q))
    q, h, s = q[o], h[o], s[o]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    ok = rank <= k + 1
    return q[ok], h[ok], s[ok]
