"""Toxicity (operator 1): a counterfactually regularised linear classifier.

Features are binary: the distinct words of a text and the words' prefixes of
three to eight letters, of those that stand in MIN_TOXIC toxic rows at least. Logistic regression with a small L1 penalty is fitted on
a bounded sample of labelled rows. For every labelled sentence that names a
group, and for a list of neutral carrier sentences, the group's name is swapped
for others; the squared change of the score is penalised, so a neutral mention
of a group, of whichever one, does not move the score.

Sample bounds: SAMPLE_TOXIC and SAMPLE_CLEAN ids, those with the smallest hash,
and one text of each, so that reruns and other partitionings fit the same model.
The intercept is fitted under the bound INTERCEPT: a text that says nothing is clean.
The model has at most MAX_FEATURES strings and is sent to all executors.

Defined results: null and empty texts have no features and get the score of the
intercept, below 0.5; of rows that share an id the text with the smallest hash
is learned from; equal texts have equal scores; texts are scored whole,
whatever their length; rows of `labels` that repeat an id count once, as toxic
if any says so; null labels and ids are left out; without labelled rows, or
with one class only, the model is a constant; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_sample_ids, checkpointed, small_batches

SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 6_000
MAX_FEATURES = 6_000
#: Toxic rows of the sample that must have a feature.
MIN_TOXIC = 3
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Share of the toxic rows in the loss: between their share of the rows and one half.
TOXIC_SHARE = 0.25
L1, COUNTERFACTUAL, STEPS = 2e-4, 1.0, 300
#: The largest intercept: a text without features scores 0.27 at most.
INTERCEPT = -1.0
#: Words whose features a worker keeps.
CACHE_WORDS = 150_000

#: Group names that are swapped for one another, by language.
IDENTITY_TERMS = {
    "en": (
        "muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "atheist", "catholic", "women", "woman", "men", "man", "gay", "lesbian", "bisexual", "transgender", "queer", "straight",
        "black", "white", "asian", "african", "latino", "arab", "indian", "chinese", "mexican", "european", "american", "immigrant", "immigrants", "refugee", "refugees", "disabled", "deaf", "blind", "elderly", "young",
    ),
    "de": ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "frauen", "männer", "schwule", "lesben", "ausländer", "flüchtlinge", "migranten", "afrikaner", "asiaten", "türken", "araber", "behinderte", "gehörlose", "rentner"),
    "fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "femmes", "hommes", "homosexuels", "lesbiennes", "étrangers", "réfugiés", "immigrés", "africains", "asiatiques", "arabes", "handicapés", "sourds", "aveugles", "retraités"),
    "es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "mujeres", "hombres", "homosexuales", "lesbianas", "extranjeros", "refugiados", "inmigrantes", "africanos", "asiáticos", "árabes", "discapacitados", "sordos", "ciegos", "jubilados"),
}
#: Neutral sentences in which every group's name is tried.
CARRIERS = {
    "en": ("i am a {} person", "my neighbours are {}", "the {} community met on sunday", "a {} teacher and a {} doctor", "they described themselves as {}"),
    "de": ("unsere nachbarn sind {}", "die {} trafen sich am sonntag", "viele {} wohnen in der stadt"),
    "fr": ("nos voisins sont des {}", "les {} se sont réunis dimanche", "beaucoup de {} vivent en ville"),
    "es": ("nuestros vecinos son {}", "los {} se reunieron el domingo", "muchos {} viven en la ciudad"),
}
#: Each name's place among its language's; a name that two languages share is the first one's.
_PLACE = {t: (terms, i) for terms in reversed(IDENTITY_TERMS.values()) for i, t in enumerate(terms)}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_IDENTITY = re.compile(r"\b(?:" + "|".join(sorted(_PLACE, key=len, reverse=True)) + r")\b")


def word_features(word: str) -> list[str]:
    """The word itself (marked) and its prefixes."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


def features_of(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)} if text else set()


def counterfactuals(text: str | None, seed: int = 0) -> Iterator[tuple[set[str], set[str]]]:
    """Features of sentences that name a group, before and after a swap."""
    low = text.lower() if text else ""
    if not _IDENTITY.search(low):
        return
    for s in _SENTENCE.findall(low):
        for k, m in enumerate(_IDENTITY.finditer(s)):
            terms, at = _PLACE[m[0]]
            other = terms[(at + 1 + (seed + k) % (len(terms) - 1)) % len(terms)]
            yield features_of(s), features_of(s[: m.start()] + other + s[m.end() :])


def carrier_pairs() -> Iterator[tuple[set[str], set[str]]]:
    for lang, terms in IDENTITY_TERMS.items():
        for c in CARRIERS[lang]:
            for i, t in enumerate(terms):
                yield features_of(c.replace("{}", t)), features_of(c.replace("{}", terms[(i + 7) % len(terms)]))
                yield features_of(c.replace("{}", t)), features_of(c.replace("{}", ""))


class Sparse:
    """Rows of column numbers (and signs), for products with numpy only."""

    def __init__(self, rows: list[list[int]], n_cols: int, signs: list[list[float]] | None = None):
        self.n, self.n_cols = len(rows), n_cols
        self.col = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(r, dtype=np.int64) for r in rows)])
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.zeros(0, dtype=np.int64)
        self.val = np.ones(len(self.col)) if signs is None else np.fromiter((s for r in signs for s in r), dtype=float)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * e[self.row], minlength=self.n_cols)


def fit_weights(x: Sparse, y: np.ndarray, pairs: Sparse, l1: float = L1, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient descent. The toxic rows weigh TOXIC_SHARE of all."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    rate = np.where(y > 0, TOXIC_SHARE / n1, (1 - TOXIC_SHARE) / n0)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        e = (1 / (1 + np.exp(-np.clip(x.dot(w) + b, -30, 30))) - y) * rate
        g = x.back(e)
        if pairs.n:
            g = g + 2 * counterfactual / pairs.n * pairs.back(pairs.dot(w))
        return g, float(e.sum())

    # A step that the largest curvature allows, found by power iteration.
    v = np.ones(x.n_cols + 1)
    top = 1.0
    for _ in range(12):
        hx = 0.25 * rate * (x.dot(v[:-1]) + v[-1])
        u = np.append(x.back(hx), hx.sum())
        if pairs.n:
            u[:-1] += 2 * counterfactual / pairs.n * pairs.back(pairs.dot(v[:-1]))
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    step = 1.0 / (1.1 * top)
    w, b = np.zeros(x.n_cols), INTERCEPT
    wp, bp, t = w.copy(), b, 1.0
    for _ in range(steps):
        tn = (1 + math.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / tn
        wy, by = w + m * (w - wp), b + m * (b - bp)
        g, gb = gradient(wy, by)
        wp, bp = w, b
        w = wy - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b, t = min(by - step * gb, INTERCEPT), tn
    return w, b


def _sample(docs: DataFrame, labels: DataFrame, eligible: Column) -> DataFrame:
    """doc_id, text, toxic of a bounded sample of labelled documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(eligible)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bounds = ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    chosen = [bounded_sample_ids(known.where(F.col("toxic") == v), "doc_id", n) for v, n in bounds]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, eligible: Column | None = None, counterfactual: float = COUNTERFACTUAL) -> dict[str, float]:
    """Weights by feature; '' is the intercept. eligible: which label rows may be learned from (on doc_id). counterfactual: weight of the penalty on swaps."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = checkpointed(_sample(docs, labels, F.lit(True) if eligible is None else eligible))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["toxic"], strict=True):
                (toxic if y == 1 else clean).update(features_of(text))
        keys = list(toxic.keys() | clean.keys())
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pd.DataFrame({"feature": some, "t": [toxic[k] for k in some], "c": [clean[k] for k in some]})

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    if not n1 or not n0:
        return {"": 0.0 if n1 else -4.0}
    counts = sample.mapInPandas(count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= MIN_TOXIC)
    p1, p0 = (F.col("t") + 0.5) / (n1 + 1.0), (F.col("c") + 0.5) / (n0 + 1.0)
    # How surely a feature tells the classes apart: log odds in units of their standard error.
    z = F.abs(F.log(p1 / p0)) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    top = [r["feature"] for r in counts.orderBy(z.desc(), "feature").limit(MAX_FEATURES).select("feature").collect()]
    swaps = list(carrier_pairs())
    own = sorted(set(top) | {f for t in _PLACE for f in word_features(t)})
    index = {f: i for i, f in enumerate(own)}
    sent = spark.sparkContext.broadcast(index)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = sent.value
        for pdf in batches:
            rows = [np.array(sorted(at[f] for f in features_of(t) if f in at), dtype="<i4").tobytes() for t in pdf["text"]]
            pairs = [np.array([x for a, b in counterfactuals(t, int(d) % 97) for x in ([-1, *[at[f] for f in a - b if f in at], -2, *[at[f] for f in b - a if f in at]])], dtype="<i4").tobytes() for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            yield pd.DataFrame({"toxic": pdf["toxic"], "doc_id": pdf["doc_id"], "ix": rows, "swapped": pairs})

    got = sample.mapInPandas(encode, "toxic int, doc_id long, ix binary, swapped binary").orderBy("doc_id").collect()
    pair_rows, pair_signs = [], []
    for a, b in swaps:
        cols = [(index[f], 1.0) for f in a - b if f in index] + [(index[f], -1.0) for f in b - a if f in index]
        pair_rows.append([c for c, _ in cols])
        pair_signs.append([s for _, s in cols])
    for r in got:
        sign = 1.0
        for v in np.frombuffer(bytes(r["swapped"]), dtype="<i4").tolist():
            if v == -1:
                pair_rows.append([])
                pair_signs.append([])
                sign = 1.0
            elif v == -2:
                sign = -1.0
            else:
                pair_rows[-1].append(v)
                pair_signs[-1].append(sign)
    x = Sparse([np.frombuffer(bytes(r["ix"]), dtype="<i4") for r in got], len(own))
    y = np.array([1.0 if r["toxic"] == 1 else 0.0 for r in got])
    w, b = fit_weights(x, y, Sparse(pair_rows, len(own), pair_signs), counterfactual=counterfactual)
    return {f: float(v) for f, v in zip(own, w, strict=True) if v} | {"": b}


def score_text(text: str | None, model: dict[str, float], cache: dict[str, tuple[str, ...]]) -> float:
    z = model[""]
    if text:
        hits: set[str] = set()
        for w in set(_WORD.findall(text.lower())):
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple(f for f in word_features(w) if f in model)
            if got:
                hits.update(got)
        z += sum(model[f] for f in sorted(hits))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every text."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, cache = sent.value, {}
        for pdf in batches:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            s = np.array([score_text(t, own, cache) for t in pdf["text"]], dtype=float)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict[str, float], text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, all columns as they are."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, cache = sent.value, {}
        for t in texts:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            yield t.map(lambda x: score_text(x if isinstance(x, str) else None, own, cache) < 0.5).astype(bool)

    return docs.where(clean(F.col(text_col)))
