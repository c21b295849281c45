"""Vectors: embedding, normalising, nearest neighbours of a query set, and exact similarity joins.

Neither join holds a matrix of all pairs.  Both are cut by pivots: of a query set, each
query visits the cells its k-th best score so far cannot rule out; of a self-join under a threshold: with unit vectors of angle at most
theta apart, a vector can only meet members of a pivot's cell if its angle to that
pivot is at most 2 theta more than to its own.  Where that rules out little, as for text vectors under
low thresholds, a self-join is a grid of pairs of blocks instead.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize, release

#: Rows of a block of the corpus or of a cell's task; pivots of a self-join at most.
BLOCK_ROWS = 32_768
CELL_ROWS = 4_096
MAX_PIVOTS = 512
#: Numbers of a block of a self-join (24 MB of doubles); blocks that give a small one enough tasks; rows drawn to foresee the visits of cells.
BLOCK_VALUES = 3_145_728
LEAST_BLOCKS = 6
PROBES = 256
#: N-grams whose hash a text model remembers.
KEPT_NGRAMS = 200_000


def normalize(vec: Column | str) -> Column:
    """Unit length in doubles; null for null, empty and all-zero vectors."""
    v = F.col(vec) if isinstance(vec, str) else vec
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    # bound as a lambda's variable, or it would be computed anew for every element
    return F.element_at(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(d, lambda x: x / n))), 1)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two raw vectors; null if either has no direction."""
    return F.aggregate(F.zip_with(normalize(a), normalize(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def mean_vector(*vecs: Column) -> Column:
    """Element-wise mean of vectors of the same length."""
    total = vecs[0]
    for v in vecs[1:]:
        total = F.zip_with(total, v, lambda x, y: x + y)
    return F.transform(total, lambda x: x / F.lit(float(len(vecs))))


def mean_pool(df: DataFrame, keys: list[str], vec: str, out: str = "embedding", mask: str | None = None) -> DataFrame:
    """``(keys, out)``: the mean of each key's vectors (of tokens, say), element by element; rows with a false or null ``mask`` do not count.

    Sums per partition in whole vectors, so one row a key and partition is shuffled.  Keys without any
    vector have no row; vectors of a key must be of one length.
    """
    rows = df.where(F.col(vec).isNotNull() & (F.col(mask) if mask else F.lit(True))).select(*keys, F.col(vec).cast("array<double>").alias("_v"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def part(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                g = pdf.groupby(keys, dropna=False, sort=False)
                idx = g.ngroup().to_numpy()
                x = np.stack(pdf["_v"].map(np.asarray))
                total = np.zeros((idx.max() + 1, x.shape[1]))
                np.add.at(total, idx, x)
                first = pdf[keys].iloc[np.unique(idx, return_index=True)[1]].reset_index(drop=True)
                yield first.assign(_n=np.bincount(idx), _v=list(total))

    sums = rows.mapInPandas(part, f"{kinds}, _n long, _v array<double>")
    long = sums.select(*keys, "_n", F.posexplode("_v").alias("_p", "_x")).groupBy(*keys, "_p").agg((F.sum("_x") / F.sum("_n")).alias("_x"))
    return long.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_x"))), lambda s: s["_x"]).alias(out))  # one number a dimension


def joint_models(vecs: list[Column | str]) -> Column:
    """One vector whose dot product is the mean cosine over the models: unit vectors side by side, scaled by 1/sqrt(M)."""
    scale = 1 / math.sqrt(len(vecs))
    return F.transform(F.concat(*[normalize(v) for v in vecs]), lambda x: x * scale)


def hashed_embedding(dim: int = 96, ngram: int = 3, seed: int = 0) -> Callable[[list[str]], np.ndarray]:
    """A deterministic text model: signed hashed character n-grams of the padded lower-cased text."""

    class Slots(dict):
        """Twice the dimension of an n-gram, plus one if it counts negatively; kept for the first KEPT_NGRAMS."""

        def __missing__(self, gram: str) -> int:
            h = zlib.crc32(f"{seed}|{gram}".encode())
            at = (h >> 1) % dim * 2 + 1 - (h & 1)
            if len(self) < KEPT_NGRAMS:
                self[gram] = at
            return at

    slots = Slots()

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for r, t in enumerate(texts):
            s = f"  {t.lower()} "
            n = np.bincount([slots[s[i : i + n]] for n in (ngram - 1, ngram, ngram + 1) for i in range(len(s) - n + 1)], minlength=2 * dim)
            out[r] = n[::2] - n[1::2]
        return out

    return encode


def embed(df: DataFrame, text: str, models: dict[str, Callable[[list[str]], np.ndarray]], out: str = "embedding", batch: int = 256,
          prefixes: dict[str, str] | None = None) -> DataFrame:
    """``df`` times models: ``model`` and ``embedding array<float>`` of each text, batch by batch.

    Texts should be distinct beforehand, as the model sees every row.  Null and empty texts are
    encoded as ``<PAD>``.  A model's prefix is put before its own input only.
    """
    names = df.columns
    prefixes = prefixes or {}

    def run(batches: Iterable) -> Iterator:
        for pdf in batches:
            for m, encode in models.items():
                for a in range(0, len(pdf), batch):
                    part = pdf.iloc[a : a + batch]
                    v = encode([prefixes.get(m, "") + (t or "<PAD>") for t in part[text]])
                    yield part[names].assign(model=m, **{out: list(np.asarray(v, np.float32))})

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{ddl}, model string, {out} array<float>")


def _raw(rows) -> np.ndarray:
    return np.array([np.asarray(r, np.float64) for r in rows])


def dot_score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot product of raw vectors."""
    return a @ b.T


def euclidean_score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Negative Euclidean distance."""
    return -np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _unit(rows) -> np.ndarray:
    x = _raw(rows)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _nearly(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, sure)``: rows of two blocks of unit vectors in single precision that may reach ``least``, and which of them surely do."""
    slack = 1.2e-7 * (a.shape[1] + 4)  # of a product of unit vectors in single precision
    s = a @ b.T
    i, j = np.divmod(np.flatnonzero(s.ravel() >= np.float32(least - slack)), max(1, s.shape[1]))
    return i, j, s[i, j] >= np.float32(least + slack)


def dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows i of a and j of b in doubles, each alike wherever it stands."""
    out = np.empty(len(i))
    for x in range(0, len(i), 32_768):
        at = slice(x, x + 32_768)
        out[at] = np.einsum("ij,ij->i", a[i[at]], b[j[at]])
    return out


def near_rows(a: np.ndarray, b: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(i, j)``, by and by: the rows of two blocks of unit vectors whose product in doubles is at least ``least``.

    Single precision decides all but the products next to ``least``.  For one block with itself, pairs i < j.
    """
    a32 = a.astype(np.float32)
    b32 = a32 if b is a else b.astype(np.float32)
    for x in range(0, len(a), 1_024):
        for y in range(x if b is a else 0, len(b), 8_192):
            i, j, sure = _nearly(a32[x : x + 1_024], b32[y : y + 8_192], least)
            i, j = i + x, j + y
            if b is a:
                ok = i < j
                i, j, sure = i[ok], j[ok], sure[ok]
            ask = np.flatnonzero(~sure)
            sure[ask] = dots(a, b, i[ask], j[ask]) >= least
            yield i[sure], j[sure]


def block_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows (i, ...)`` once for every pair ``_a <= _b`` of blocks that their own block ``_own`` is part of; few pairs share a partition."""
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    r = rows.withColumn("_own", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")).withColumn("_o", other)
    r = r.withColumn("_a", F.least("_own", "_o")).withColumn("_b", F.greatest("_own", "_o")).drop("_o")
    return r.repartition(min(2_000, 2 * blocks * (blocks - 1) + 1), "_a", "_b")


def grid_blocks(n: int, dim: int) -> int:
    """Blocks of a self-join of n vectors: none above BLOCK_VALUES, and enough of them to share the work."""
    return max(1, math.ceil(n / max(1, BLOCK_VALUES // max(1, dim))), min(LEAST_BLOCKS, math.ceil(n / CELL_ROWS)))


def unit_rows(v) -> np.ndarray:
    """Unit vectors in doubles of an Arrow array of lists of one length."""
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x


def grid_sides(table) -> tuple:
    """``(table, p, q, x, y)`` of a pair of blocks: its rows by id, the places of the rows of either block among them, and their unit vectors ``v``; x is y for one block with itself."""
    import pyarrow.compute as pc

    order = pc.sort_indices(table["i"])
    t = table.drop_columns(["v"]).take(order).combine_chunks()
    v, at, own = table["v"].combine_chunks(), order.to_numpy(), t["_own"].to_numpy()
    p = np.flatnonzero(own == t["_a"][0].as_py())
    x = unit_rows(v.take(at[p]))
    if t["_a"][0].as_py() == t["_b"][0].as_py():
        return t, p, p, x, x
    q = np.flatnonzero(own == t["_b"][0].as_py())
    return t, p, q, x, unit_rows(v.take(at[q]))


def _meet_blocks(threshold: float):
    """Pairs between two blocks, or within one."""

    def meet(table):
        import pyarrow as pa

        t, p, q, x, y = grid_sides(table)
        ids = t["i"].combine_chunks()
        parts = [(p[i], q[j], dots(x, y, i, j)) for i, j in near_rows(x, y, threshold)]
        i, j, s = (np.concatenate([r[k] for r in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"i": ids.take(pa.array(np.minimum(i, j))), "j": ids.take(pa.array(np.maximum(i, j))), "s": s})

    return meet


def usable(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)))


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, corpus_id: str, vec: str, by: list[str] | None = None,
        min_score: float | None = None, block_rows: int = BLOCK_ROWS, exclude_self: bool = False, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(by, query_id, corpus_id, score, rank)``: the k most similar corpus rows of every query, exactly, in doubles.

    ``by`` (e.g. the model) must agree between the sides.  A corpus of more than ``block_rows`` rows is cut
    into the cells of at most MAX_PIVOTS pivots (a bounded sample).  A query first visits the cell of its
    nearest pivot; its k-th score there bounds the angle, and it then visits only the cells that reach into
    that angle.  Cells and their queries beyond ``block_rows`` are split among tasks, so no side is broadcast
    and no cell meets one task.  Ties go to the smaller corpus id.  Vectors without direction take no part;
    vectors of different length are never compared.  ``score`` takes two matrices of raw vectors and gives
    their similarities, larger for nearer; the cosine is the default.  Another score has no such bound: its
    queries visit every block.
    """
    by = by or []
    q = usable(queries, vec).select(*by, F.col(query_id).alias("_q"), F.col(vec).alias("_v"), F.size(vec).alias("_d"))
    c = usable(corpus, vec).select(*by, F.col(corpus_id).alias("_c"), F.col(vec).alias("_v"), F.size(vec).alias("_d"))
    search = _block_search(by, query_id, corpus_id, k, min_score, exclude_self, score)
    qt, ct = queries.schema[query_id].dataType.simpleString(), corpus.schema[corpus_id].dataType.simpleString()
    bt = "".join(f"`{b}` {queries.schema[b].dataType.simpleString()}, " for b in by)
    out = f"{bt}`{query_id}` {qt}, `{corpus_id}` {ct}, score double"
    w = Window.partitionBy(*by, query_id).orderBy(F.desc("score"), corpus_id)

    def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, out)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    n = corpus.count()
    if n <= block_rows or score is not None:
        # a grid of blocks of both sides, fixed by their counts
        blocks, qblocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(queries.count() / block_rows))
        left = q.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_s", F.pmod(F.xxhash64("_q"), F.lit(qblocks)))
        right = c.withColumn("_b", F.pmod(F.xxhash64("_c"), F.lit(blocks)).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))))
        return meet(left, right, [*by, "_d", "_b", "_s"])
    spark = queries.sparkSession
    pivots = min(MAX_PIVOTS, 4 * math.ceil(n / block_rows))
    drawn = c.select(*by, "_d", "_v").sample(min(1.0, 8 * pivots / n), 7).limit(pivots).collect()  # at most MAX_PIVOTS rows
    held: dict[tuple, list] = {}
    for r in drawn:
        held.setdefault((*[r[b] for b in by], r["_d"]), []).append(np.asarray(r["_v"], np.float64))
    sent = spark.sparkContext.broadcast({key: np.stack(v) / np.linalg.norm(np.stack(v), axis=1)[:, None] for key, v in held.items()})

    def angles(pdf):
        """(rows, angles to their group's pivots) of every group; one zero angle where a group has no pivot."""
        for key, g in pdf.groupby([*by, "_d"], dropna=False, sort=False):
            p = sent.value.get(tuple(x.item() if hasattr(x, "item") else x for x in key))
            yield g, np.zeros((len(g), 1)) if p is None else np.arccos(np.clip(_unit(g["_v"]) @ p.T, -1, 1))

    def place(batches: Iterable) -> Iterator:
        for pdf in batches:
            for g, a in angles(pdf):
                own = a.argmin(axis=1)
                yield g.assign(_cell=own.astype(np.int32), _a=a[np.arange(len(a)), own])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields)
    placed = materialize(c.mapInPandas(place, f"{ddl}, _cell int, _a double"), "knn-corpus")
    keys = [*by, "_d", "_cell"]
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_a").alias("radius")).collect()  # one row a pivot and group
    reach: dict[tuple, dict[int, float]] = {}
    for r in sizes:
        reach.setdefault((*[r[b] for b in by], r["_d"]), {})[r["_cell"]] = r["radius"]
    known = spark.sparkContext.broadcast(reach)

    def visit(first: bool):
        def run(batches: Iterable) -> Iterator:
            import pandas as pd

            for pdf in batches:
                for g, a in angles(pdf):
                    cells = known.value.get(tuple(x.item() if hasattr(x, "item") else x for x in g[[*by, "_d"]].iloc[0]), {})
                    names = np.array(sorted(cells), np.int64)
                    if not len(names):
                        continue
                    a = a[:, names]
                    near = a.argmin(axis=1)
                    if first:
                        yield g.assign(_cell=names[near].astype(np.int32))
                        continue
                    radius = np.array([cells[x] for x in names])
                    ok = a - radius[None] <= np.arccos(np.clip(g["_k"].to_numpy(np.float64), -1, 1))[:, None] + 1e-6
                    ok[np.arange(len(a)), near] = False
                    i, j = np.nonzero(ok)
                    yield pd.DataFrame(g.drop(columns=["_k"]).iloc[i]).assign(_cell=names[j].astype(np.int32))

        return run

    qddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)

    def search_cells(asked: DataFrame, name: str) -> DataFrame:
        """Every query meets all blocks of its cell; blocks and queries of a cell are split by their numbers."""
        asked = materialize(asked, "knn-asked")
        many = asked.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_qs"))
        blocks = placed.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_bs"))
        split = many.join(blocks, [*by, "_d", "_cell"])  # one row a cell
        left = asked.join(F.broadcast(split), keys).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_bs") - 1))).withColumn("_s", F.pmod(F.xxhash64("_q"), F.col("_qs")).cast("int"))
        right = placed.join(F.broadcast(split), keys).withColumn("_b", F.pmod(F.xxhash64("_c"), F.col("_bs")).cast("int")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)))
        cols = [*by, "_q", "_v", "_d", "_cell", "_b", "_s"]
        found = materialize(meet(left.select(*cols), right.select(*[x if x != "_q" else "_c" for x in cols]), [*keys, "_b", "_s"]), name)
        release(asked)
        return found

    near = search_cells(q.mapInPandas(visit(True), f"{qddl}, _cell int"), "knn-first")
    kth = near.groupBy(*by, F.col(query_id).alias("_q")).agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-1.0)).alias("_k"))
    if min_score is not None:
        kth = kth.withColumn("_k", F.greatest("_k", F.lit(float(min_score))))
    # a query without any hit so far knows no bound
    same = [q[b].eqNullSafe(kth[b]) for b in by]
    cond = q["_q"] == kth["_q"]
    for x in same:
        cond = cond & x
    bounded = q.join(kth, cond, "left").select(*[q[x] for x in q.columns], F.coalesce(kth["_k"], F.lit(-1.0 if min_score is None else float(min_score))).alias("_k"))
    more = search_cells(bounded.mapInPandas(visit(False), f"{qddl}, _cell int"), "knn-more")
    release(placed)
    both = near.unionByName(more).drop("rank")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _block_search(by: list[str], query_id: str, corpus_id: str, k: int, min_score: float | None, exclude_self: bool, score):
    """The k best rows of a block for each of its queries."""

    def search(left, right):
        import pandas as pd

        cols = [*by, query_id, corpus_id, "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({x: [] for x in cols}, dtype=object)
        right = right.sort_values("_c", kind="stable")
        x = _unit(right["_v"]) if score is None else _raw(right["_v"])
        single = x.astype(np.float32) if score is None and min_score is not None else None
        ids = right["_c"].to_numpy()
        parts = []
        step = max(1, 2 * BLOCK_VALUES // len(right))
        for a in range(0, len(left), step):
            part = left.iloc[a : a + step]
            if score is None and min_score is not None:
                u, q = _unit(part["_v"]), part["_q"].to_numpy()
                i, j, _ = _nearly(u.astype(np.float32), single, min_score)
                if len(i) <= 64 * len(part):  # few are left: no sorting of whole rows
                    s = dots(u, x, i, j)
                    ok = (s >= min_score) & ((q[i] != ids[j]) | (not exclude_self))
                    f = pd.DataFrame({query_id: q[i[ok]], corpus_id: ids[j[ok]], "score": s[ok]})
                    parts.append(f.sort_values([query_id, "score", corpus_id], ascending=[True, False, True], kind="stable").groupby(query_id, sort=False).head(k))
                    continue
            s = _unit(part["_v"]) @ x.T if score is None else np.array(score(_raw(part["_v"]), x), np.float64)
            if exclude_self:
                s[part["_q"].to_numpy()[:, None] == ids[None]] = -np.inf
            n = min(k, s.shape[1])
            kth = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero((s >= kth[:, None]) & np.isfinite(s) & (s >= (-np.inf if min_score is None else min_score)))
            f = pd.DataFrame({query_id: part["_q"].to_numpy()[i], corpus_id: ids[j], "score": s[i, j]})
            f = f.sort_values([query_id, "score", corpus_id], ascending=[True, False, True], kind="stable").groupby(query_id, sort=False).head(n)
            parts.append(f)
        out = pd.concat(parts)
        if not len(out):
            return pd.DataFrame({x: [] for x in cols}, dtype=object)
        for b in by:
            out[b] = left[b].iloc[0]
        return out[cols]

    return search


def similarity_pairs(df: DataFrame, id_col: str, vec: str, threshold: float, seed: int = 7) -> DataFrame:
    """``(i, j, s)`` with i < j: all pairs of rows of cosine at least ``threshold`` (inclusive, in doubles), exactly.

    Up to CELL_ROWS rows are one matrix product in one task.  Larger inputs are cut by at most MAX_PIVOTS pivots (a
    bounded sample of the rows): a row goes to its nearest pivot's cell and to every other cell that
    can hold a partner.  Large cells are split among tasks by salting, so a hot cell never meets one
    task.  Where PROBES sampled rows would visit more cells than a grid has blocks, the rows meet in the grid of
    all pairs of blocks.  Vectors without direction take no part; equal vectors are paired like any others.
    """
    whole = usable(df, vec).select(F.col(id_col).alias("i"), F.col(vec).alias("v"))
    n = whole.count()
    rows = whole.select("i", normalize("v").alias("v"))
    kind = df.schema[id_col].dataType.simpleString()
    if n <= CELL_ROWS:  # counted: a bounded group
        one = rows.select(F.lit(0).alias("cell"), F.lit(0).alias("salt"), F.lit(0).alias("own"), F.lit(True).alias("at"), "i", "v")
        return one.groupBy("cell", "salt", F.size("v").alias("d")).applyInPandas(_meet(threshold), f"i {kind}, j {kind}, s double")
    lengths = sorted(r["d"] for r in whole.select(F.size("v").alias("d")).distinct().collect())  # a few models' lengths
    if len(lengths) > 1:
        each = [similarity_pairs(df.where(F.size(vec) == d), id_col, vec, threshold, seed) for d in lengths]
        out = each[0]
        for other in each[1:]:
            out = out.unionByName(other)
        return out
    pivots = min(MAX_PIVOTS, max(2, math.ceil(n / CELL_ROWS) * 2))
    sample = whole.sample(min(1.0, 4 * (pivots + PROBES) / n), seed).limit(pivots + PROBES).toPandas()  # at most MAX_PIVOTS + PROBES rows
    drawn = _unit(sample["v"])
    p, probes = drawn[:pivots], drawn[pivots:]
    theta = math.acos(max(-1.0, min(1.0, threshold))) + 1e-9
    seen = np.arccos(np.clip(probes @ p.T, -1, 1))
    visits = (seen <= seen.min(axis=1)[:, None] + 2 * theta).sum(axis=1).mean() if len(probes) else len(p)
    blocks = grid_blocks(n, lengths[0])
    if visits > min(blocks, pivots / 2):
        return block_pairs(whole, blocks).groupBy("_a", "_b").applyInArrow(_meet_blocks(threshold), f"i {kind}, j {kind}, s double")
    rows = materialize(rows, "pair-rows")
    held = df.sparkSession.sparkContext.broadcast(p)

    def route(batches: Iterable) -> Iterator:
        import pandas as pd

        piv = held.value
        for pdf in batches:
            v = np.stack(pdf["v"].map(lambda x: np.asarray(x, np.float64)))
            ang = np.arccos(np.clip(v @ piv.T, -1, 1))
            own = ang.argmin(axis=1)
            visits, visited = np.nonzero(ang <= ang[np.arange(len(v)), own][:, None] + 2 * theta)
            step = max(1, BLOCK_VALUES // v.shape[1])
            for a in range(0, len(visits), step):  # a batch's copies can be many
                r, c = visits[a : a + step], visited[a : a + step]
                yield pd.DataFrame({"cell": c.astype(np.int32), "home": own[r] == c, "own": own[r].astype(np.int32), "i": pdf["i"].to_numpy()[r], "v": list(v[r])})

    routed = rows.mapInPandas(route, f"cell int, home boolean, own int, i {kind}, v array<double>")
    sizes = {r["cell"]: r["n"] for r in routed.where("home").groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    salts = {c: max(1, math.ceil(x / (2 * CELL_ROWS))) for c, x in sizes.items()}
    table = df.sparkSession.createDataFrame([(c, s) for c, s in salts.items()], "cell int, salts int")
    salted = routed.join(F.broadcast(table), "cell")
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    salted = salted.withColumn("at", F.col("home") & (F.pmod(F.xxhash64("i"), F.col("salts")) == F.col("salt"))).drop("salts")
    return salted.groupBy("cell", "salt").applyInPandas(_meet(threshold), f"i {kind}, j {kind}, s double")


def _meet(threshold: float):
    """Pairs of a cell's own rows with all its visitors, in blocks."""

    def meet(pdf):
        import pandas as pd

        pdf = pdf.sort_values("i", kind="stable")
        at = pdf["at"].to_numpy()
        h, ids, own = np.flatnonzero(at), pdf["i"].to_numpy(), pdf["own"].to_numpy()
        parts = []
        if len(h):
            v = np.stack(pdf["v"].map(np.asarray))
            cell = int(pdf["cell"].iloc[0])
            for a in range(0, len(pdf), 2_048):
                q = np.arange(a, min(a + 2_048, len(pdf)))
                s = v[q] @ v[h].T
                x, y = np.nonzero(s >= threshold - 1e-12)
                gi, gj = q[x], h[y]
                # of a pair, the row of the larger cell (or id within a cell) comes as the visitor
                ok = (own[gi] > cell) | (own[gi] == cell) & (ids[gi] > ids[gj])
                gi, gj, sv = gi[ok], gj[ok], s[x[ok], y[ok]]
                parts.append(pd.DataFrame({"i": np.where(ids[gi] < ids[gj], ids[gi], ids[gj]), "j": np.where(ids[gi] < ids[gj], ids[gj], ids[gi]), "s": sv}))
        out = pd.concat(parts) if parts else pd.DataFrame({"i": [], "j": [], "s": []}, dtype=object)
        return out[out["s"] >= threshold]

    return meet
