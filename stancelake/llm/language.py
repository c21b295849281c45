"""Language of documents and of their paragraphs.

Sparse multinomial logistic regression on TF-IDF character n-grams.  The weights
are learned by follow-the-regularised-leader with elastic-net penalties; labels
that a model of the other half of the sample contradicts are left out of the final
fit; a temperature fitted on held-out rows turns the scores into calibrated confidences.

Document frequencies are counted over all paragraphs.  Only the fit uses a sample,
bounded by ``per_label`` rows a label.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: The languages and the names a label may give them.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "it": ("it", "ita", "italian"),
    "pt": ("pt", "por", "portuguese"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pl": ("pl", "pol", "polish"),
    "uk": ("uk", "ukr", "ukrainian"),
}
LANGUAGES = tuple(NAMES)
BITS = 15
ORDERS = (1, 2, 3)
BLANK_LINE = re.compile(r"\r?\n[^\S\n]*\n\s*")


def label_language(label: Column) -> Column:
    """The language code a free-form label names, or null: a code with or without region, or an English name."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z0-9]+)?$", 1)
    table = F.create_map(*[F.lit(x) for code, names in NAMES.items() for n in names for x in (n, code)])
    return F.element_at(table, base)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(id, seg, text, label)``: the paragraphs that have at least one letter; seg counts all of them from 0, a repeated document is repeated."""
    parts = F.split(F.regexp_replace(F.col(text_col), r"\r\n", "\n"), r"\n[^\S\n]*\n\s*")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), label_language(F.col(label_col)).alias("label"), F.posexplode(parts).alias("seg", "text"))
    return rows.where(F.col("text").rlike(r"\p{L}"))


def _letters(text: str) -> str:
    """The text in lower case, everything but letters one blank."""
    return re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hashed character n-gram, occurrences) of whole texts, ordered by text and n-gram."""
    s = [_letters(t) for t in texts]
    c = np.frombuffer("".join(s).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(s)), [len(x) for x in s])
    keys = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(c) < n:
                continue
            h = np.full(len(c) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ c[j : len(c) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            own = doc[: len(doc) - n + 1]
            inside = own == doc[n - 1 :]  # no n-gram reaches into the next text
            keys.append((own[inside] << BITS) | (h[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64))
    key = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return key[first] >> BITS, key[first] & ((1 << BITS) - 1), np.diff(np.append(first, len(key)))


def _blocks(texts: list[str], letters: int = 500_000) -> Iterator[list[str]]:
    """The texts in blocks of about that many characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= letters:
            yield texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield texts[a:]


def document_frequencies(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all rows each hashed n-gram occurs, and the number of rows."""

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        df, n = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for block in _blocks(pdf["text"].tolist()):
                df += np.bincount(gram_counts(block)[1], minlength=1 << BITS)
                n += len(block)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"g": np.append(at, -1), "n": np.append(df[at], n)})

    counts = rows.select(F.col(text).alias("text")).mapInPandas(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toPandas()  # at most 2^BITS + 1 rows
    df = np.zeros(1 << BITS, np.int64)
    g, n = counts["g"].to_numpy(), counts["n"].to_numpy()
    df[g[g >= 0]] = n[g >= 0]
    return df, int(n[g < 0].sum())


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, value): sparse unit TF-IDF vectors."""
    doc, g, tf = gram_counts(texts)
    v = (1 + np.log(tf)) * idf[g]
    norm = np.sqrt(np.bincount(doc, v * v, len(texts)))
    return doc, g, v / np.maximum(norm, 1e-12)[doc]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit TF-IDF vector: indices and values."""
    return vectors([text], idf)[1:]


@dataclass
class Model:
    """Weights (n-grams x languages), inverse document frequencies and the temperature."""

    weights: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): calibrated probabilities."""
        out = [np.empty((0, self.weights.shape[1]))]
        for block in _blocks(texts):
            doc, g, v = vectors(block, self.idf)
            z = np.stack([np.bincount(doc, v * self.weights[g, k], len(block)) for k in range(self.weights.shape[1])], axis=1) / self.temperature
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 2, alpha: float = 2.0, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.2, seed: int = 3) -> np.ndarray:
    """Weights of a multinomial logistic regression by FTRL-proximal with elastic net."""
    z = np.zeros((1 << BITS, classes))
    n = np.zeros((1 << BITS, classes))

    def weights(zz: np.ndarray, nn: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            g, v = rows[i]
            zi, ni = z[g], n[g]
            w = weights(zi, ni)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = v[:, None] * p[None]
            more = ni + grad * grad
            z[g] = zi + grad - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[g] = more
    return weights(z, n)


def fit(rows: DataFrame, per_label: int = 1500) -> Model:
    """Fit on a sample of at most ``per_label`` labelled paragraphs a language (documented bound); idf over all rows.

    Without any labelled row every language is equally likely.
    """
    df, total = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    counts = {r["label"]: r["n"] for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return Model(np.zeros((1 << BITS, len(LANGUAGES))), idf)
    u = F.pmod(F.xxhash64("id", "seg", "text"), F.lit(1_000_003)) / 1_000_003.0
    keep = F.lit(False)
    for lab, c in counts.items():
        keep = keep | ((F.col("label") == lab) & (u < min(1.0, per_label / c)))
    sample = rows.where("label is not null").where(keep).select("id", "seg", "text", "label").limit(2 * per_label * len(LANGUAGES)).toPandas()
    sample = sample.sort_values(["id", "seg", "text"], kind="stable")
    x = [features(t, idf) for t in sample["text"]]
    y = np.array([LANGUAGES.index(v) for v in sample["label"]])
    k = len(LANGUAGES)

    def guess(w: np.ndarray, i: int) -> int:
        return int((x[i][1] @ w[x[i][0]]).argmax())

    # cross-fitting: a label is trusted if the model of the other half agrees with it
    fold = np.arange(len(x)) % 2
    trusted = np.arange(len(x))
    for _ in range(2 if len(x) >= 40 else 0):
        halves = [ftrl([x[i] for i in t], y[t], k, epochs=1) for t in (trusted[fold[trusted] == f] for f in (0, 1))]
        agreed = np.array([i for i in range(len(x)) if guess(halves[1 - fold[i]], i) == y[i]], np.int64)
        trusted = agreed if len(agreed) else trusted
    held = trusted[::5]
    train = np.setdiff1d(trusted, held) if len(trusted) >= 10 else trusted
    w = ftrl([x[i] for i in train], y[train], k)
    # calibrated on cuts of the held-out rows of every length, since whole paragraphs are hardly ever in doubt
    rng = np.random.default_rng(7)
    cuts = []
    for i in held:
        words = sample["text"].iloc[i].split()
        a = int(rng.integers(0, max(len(words) - 1, 1)))
        g, v = features(" ".join(words[a : a + int(rng.integers(1, 8))]) or "-", idf)
        cuts.append(v @ w[g])
    s = np.array(cuts)

    def loss(log_t: float) -> float:
        a = s / np.exp(log_t)
        a = a - a.max(axis=1, keepdims=True)
        return float(-(a[np.arange(len(held)), y[held]] - np.log(np.exp(a).sum(axis=1))).mean())

    lo, hi = -4.0, 3.0
    for _ in range(60):  # golden-section search
        a, b = hi - 0.618 * (hi - lo), lo + 0.618 * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return Model(w.astype(np.float32), idf, float(np.exp((lo + hi) / 2)))


def classify(rows: DataFrame, model: Model) -> DataFrame:
    """``(id, seg, label, lang, confidence, n_letters)`` of paragraphs."""
    held = rows.sparkSession.sparkContext.broadcast(model)  # 2^BITS x 9 weights, a fixed size
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        m = held.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            p = m.probabilities(texts)
            yield pd.DataFrame({
                "id": pdf["id"], "seg": pdf["seg"], "label": pdf["label"],
                "lang": [LANGUAGES[int(q.argmax())] for q in p], "confidence": [float(q.max()) for q in p],
                "n_letters": [len(x) - x.count(" ") for x in map(_letters, texts)],
            })

    return rows.select("id", "seg", "label", "text").mapInPandas(run, f"id {kind}, seg int, label string, lang string, confidence double, n_letters int")


def body_languages(segments: DataFrame) -> DataFrame:
    """``(id, lang, confidence, languages)``: the language with the largest confidence-weighted share of letters.

    ``confidence`` is that share; ``languages`` lists all languages of the body's paragraphs.
    """
    w = segments.withColumn("w", F.col("confidence") * F.col("n_letters")).groupBy("id", "lang").agg(F.sum("w").alias("w"))
    return w.groupBy("id").agg(
        F.max_by("lang", F.struct("w", "lang")).alias("lang"), (F.max("w") / F.sum("w")).alias("confidence"),
        F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("languages"))
