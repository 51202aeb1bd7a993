"""Language ID (operator 4): nearest clustered centroids of TF-IDF n-grams.

A text is lower-cased, everything but letters becomes one space, and its
character bigrams and trigrams are hashed to DIM columns. Rows weigh
(1 + log tf) * idf and have length one. Document frequencies are counted over
all rows that may be learned from. A bounded sample (SAMPLE_ROWS a language at
most, those with the smallest hash of id and text; equal rows count once) is clustered to CENTROIDS centroids a language by
spherical k-means. A text gets the language of the centroid with the largest
cosine. It is rejected beyond a distance of MAX_DISTANCE (a text without a letter
is at distance 1), and below half the cosine that nearly all learned texts of
its length reach in that language: fit thins the sample's rows to 1, 2, 4, ...
n-grams and takes the OWN_QUANTILE quantile of each length and language.

Defined results: null and empty texts and those without a letter are `und` with
score 0; the score is the cosine, 0 to 1; ties go to the language that sorts
first; rows without a language teach nothing; without any row to learn from
everything is `und`; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import checkpointed, small_batches

DIM = 4096
SAMPLE_ROWS = 400
#: Languages are few; with more than this many the sample per language shrinks, so that the whole stays bounded.
SAMPLE_TOTAL = 8_000
CENTROIDS = 4
MAX_DISTANCE = 0.97
#: Quantile of the learned texts' own cosines, and the share of it that a text must reach: collisions alone give far less, unseen texts of the language more.
OWN_QUANTILE, OWN_SHARE = 0.01, 0.5
#: Lengths of texts, as powers of two of n-grams, that have limits of their own; longer texts have the last one's.
LENGTHS = 24
UNKNOWN = "und"
_MAP: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space: made once a worker from the Unicode tables."""
    if not _MAP:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _MAP.append(table)
    return _MAP[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed bigrams and trigrams; None without a letter."""
    if not text:
        return None
    cp = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    keep = np.ones(len(cp), dtype=bool)
    keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    cp = cp[keep]
    if len(cp) == 0 or (len(cp) == 1 and cp[0] == 32):
        return None
    cp = np.concatenate(([32], cp, [32])).astype(np.uint32)
    two = (cp[:-1] * np.uint32(0x9E3779B1)) ^ (cp[1:] * np.uint32(0x85EBCA77))
    three = (two[:-1] * np.uint32(0xC2B2AE3D)) ^ (cp[2:] * np.uint32(0x27D4EB2F))
    shift = np.uint32(32 - DIM.bit_length() + 1)
    h = np.concatenate(((two * np.uint32(0x165667B1)) >> shift, (three * np.uint32(0x9E3779B1)) >> shift))
    return np.bincount(h, minlength=DIM)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """k centroids of length one (fewer rows: one a row). Starts from rows far from one another; no randomness."""
    k = min(k, len(x))
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < k:
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def own_limits(counts: np.ndarray, c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(LENGTHS,): a share OWN_SHARE of the cosine that all but OWN_QUANTILE of a language's rows, thinned to 2 ** length n-grams, reach with its centroids.

    A length that under a quarter of the rows have takes the limit of the next shorter one: few rows make no quantile.
    """
    rng = np.random.default_rng(0)
    seen: list[list[float]] = [[] for _ in range(LENGTHS)]
    for row in counts:
        grams = rng.permutation(np.repeat(np.arange(DIM), row))
        thin = np.stack([np.bincount(grams[: 1 << p], minlength=DIM) for p in range(min(LENGTHS, len(grams).bit_length()))])
        for p, cos in enumerate((weighted(thin, idf) @ c.T).max(axis=1)):
            seen[p].append(float(cos))
    out = np.zeros(LENGTHS, dtype=np.float32)
    for p, cos in enumerate(seen):
        out[p] = OWN_SHARE * np.quantile(cos, OWN_QUANTILE) if cos and 4 * len(cos) >= len(counts) else out[p - 1] if p else 0.0
    return out


def fit(docs: DataFrame, eligible: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: idf, centroids, and the language and, by length, the limits of each centroid. eligible: which rows may be learned from."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.lit(True) if eligible is None else eligible).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n_rows = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = min(SAMPLE_ROWS, max(1, SAMPLE_TOTAL // max(1, len(n_rows))))
    # Rows whose hash is below the language's share, the same ones on every run: a few more than `each` of them are expected.
    share = F.create_map(*[F.lit(v) for k, n in sorted(n_rows.items()) for v in (k, min(1.0, 1.3 * each / n))])[F.col("lang")] if n_rows else F.lit(1.0)
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 60))
    taught = rows.withColumn("slot", F.when(hashed < share * float(1 << 60), hashed))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, sample = np.zeros(DIM, dtype=np.int64), 0, {}
        for pdf in batches:
            for text, lang, slot in zip(pdf["text"], pdf["lang"], pdf["slot"].astype("Int64").array, strict=True):
                c = ngram_counts(text)
                if c is None:
                    continue
                df += c > 0
                n += 1
                if slot is not pd.NA:
                    sample[lang, int(slot)] = np.minimum(c, 65535).astype("<u2").tobytes()  # rows that are repeated have one slot
        yield pd.DataFrame({"lang": [None], "data": [None], "number": [n], "df": [df]})
        if sample:
            yield pd.DataFrame({"lang": [s[0] for s in sample], "data": list(sample.values()), "number": [s[1] for s in sample], "df": None})

    # One pass over the texts gives a row of DIM numbers a partition, which Spark adds up, and the bounded sample.
    seen = checkpointed(taught.select("text", "lang", "slot").mapInPandas(learn, "lang string, data binary, number long, df array<long>"))
    counted = seen.where(F.col("df").isNotNull())
    n = counted.agg(F.coalesce(F.sum("number"), F.lit(0)).alias("n")).collect()[0]["n"]
    idf_sum = np.zeros(DIM, dtype=np.int64)
    for r in counted.select(F.posexplode("df").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
        idf_sum[r["at"]] = r["v"]
    samples: dict[str, list[tuple[int, bytes]]] = {}
    sampled = seen.where(F.col("lang").isNotNull()).select("lang", "number", "data").dropDuplicates(["lang", "number"])
    least = F.row_number().over(Window.partitionBy("lang").orderBy("number"))
    for r in sampled.withColumn("at", least).where(F.col("at") <= each).select("lang", "number", "data").collect():
        samples.setdefault(r["lang"], []).append((r["number"], bytes(r["data"])))
    idf = (np.log((n + 1) / (idf_sum + 1)) + 1).astype(np.float32)
    langs, centroids, limits = [], [], []
    for lang in sorted(samples):
        some = sorted(samples[lang])
        own = np.stack([np.frombuffer(d, dtype="<u2") for _, d in some])
        x = weighted(own, idf)
        c = spherical_kmeans(x, CENTROIDS)
        limits.append(np.tile(own_limits(own, c, idf), (len(c), 1)))
        centroids.append(c)
        langs += [lang] * len(c)
    return {"idf": idf, "centroids": np.concatenate(centroids).astype(np.float32) if centroids else np.zeros((0, DIM), np.float32), "langs": langs, "limits": np.concatenate(limits) if limits else np.zeros((0, LENGTHS), np.float32)}


def predict_batch(texts: list[str | None], model: dict) -> list[tuple[str, float, bool]]:
    """(nearest language, cosine, whether it is beyond MAX_DISTANCE or its limit) of each text."""
    langs, out = model["langs"], []
    for at in range(0, len(texts), 256):
        counts = [ngram_counts(t) for t in texts[at : at + 256]]
        some = [c for c in counts if c is not None]
        if not langs or not some:
            out += [(UNKNOWN, 0.0, True)] * len(counts)
            continue
        cos = weighted(np.stack(some), model["idf"]) @ model["centroids"].T
        best, j = np.argmax(cos, axis=1), 0
        for c in counts:
            if c is None:
                out.append((UNKNOWN, 0.0, True))
            else:
                s = float(min(1.0, max(0.0, cos[j, best[j]])))
                length = min(LENGTHS, int(c.sum()).bit_length()) - 1
                out.append((langs[best[j]], s, bool(1 - s > MAX_DISTANCE or s < model["limits"][best[j], length])))
                j += 1
    return out


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred (nearest language; `und` without a letter), score, rejected (too far from every centroid)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in batches:
            got = predict_batch(pdf["text"].tolist(), own)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].array, "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")
