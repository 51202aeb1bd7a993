"""Approximate nearest neighbours (operator 8): score-aware anisotropic quantisation.

Vectors are brought to length one and cut into subspaces of two dimensions with
16 codewords each, so a code has four bits. Codebooks are fitted on a bounded
sample (SAMPLE_ROWS rows) by alternating minimisation of the anisotropic loss:
the part of the residual that is parallel to the vector, which is what changes
large inner products, weighs ETA times the part across it. Every row is encoded
the same way, by coordinate descent, once, and its codes travel packed, two a byte.

The search scans four-bit tables: rows lie in blocks of at most BLOCK_ROWS, the
queries in blocks of at most QUERY_ROWS, and each pair of blocks is one bounded
task. A query's RERANK best rows of a block by the tables give a cosine that the
k best reach at least; then every row whose table score, with the angle between
the row and what its code decodes to, allows that cosine is scored exactly
(cosine in double precision on the original vectors), however many these are.
Only the best k a block leave the task, and a last ranking joins the blocks.
Ties go to the smaller id in both steps. So the best k are exact.

Defined results: vectors that are null, empty, zero, of another length than the
commonest, or that hold null or non-finite components take no part; rows with a
null id neither; repeated ids count as separate rows of that id, and a query
never finds rows of its own id; fewer candidates than k are all returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import bounded_sample_ids, checkpointed, small_batches

SAMPLE_ROWS = 8_000
#: A block has n / 256 rows within these bounds.
LEAST_ROWS, BLOCK_ROWS = 1_024, 16_384
#: Queries that meet a block at once; rows are sent once for each so many queries.
QUERY_ROWS = 8_192
SUB, CODES = 2, 16
ETA = 4.0
RERANK = 64
#: Far above what double precision loses in a cosine or a bound.
MARGIN = 1e-7


def _cut(x: np.ndarray) -> np.ndarray:
    """Rows in subspaces: (rows, subspaces, SUB), padded with zeros."""
    pad = -x.shape[1] % SUB
    x = np.pad(x, ((0, 0), (0, pad)))
    return x.reshape(len(x), -1, SUB)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, books: np.ndarray, rounds: int = 3, eta: float = ETA) -> np.ndarray:
    """Codes of unit rows: coordinate descent on |r|^2 + (eta - 1) <r, x>^2, r the residual."""
    xs = _cut(x)
    n, m, _ = xs.shape
    codes = np.empty((n, m), dtype=np.uint8)
    across = np.empty((n, m, CODES))  # squared residual in a subspace for each codeword
    along = np.empty((n, m, CODES))  # what it adds to the parallel part
    for s in range(m):
        r = xs[:, s, None, :] - books[s][None]
        across[:, s] = (r**2).sum(-1)
        along[:, s] = (r * xs[:, s, None, :]).sum(-1)
        codes[:, s] = across[:, s].argmin(1)
    rows = np.arange(n)
    total = along[rows[:, None], np.arange(m)[None], codes].sum(1)
    for _ in range(rounds):
        for s in range(m):
            rest = total - along[rows, s, codes[:, s]]
            best = (across[:, s] + (eta - 1) * (rest[:, None] + along[:, s]) ** 2).argmin(1)
            codes[:, s] = best
            total = rest + along[rows, s, best]
    return codes


def pack(codes: np.ndarray) -> list[bytes]:
    """Four bits a code, two codes a byte."""
    even = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return [r.tobytes() for r in even[:, ::2] | (even[:, 1::2] << 4)]


def unpack(packed: list[bytes], m: int) -> np.ndarray:
    two = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    return np.stack((two & 15, two >> 4), axis=2).reshape(len(packed), -1)[:, :m]


def fit_codebooks(x: np.ndarray, rounds: int = 8, eta: float = ETA) -> np.ndarray:
    """(subspaces, CODES, SUB) codewords for unit rows."""
    xs = _cut(x)
    n, m, _ = xs.shape
    books = np.empty((m, CODES, SUB))
    for s in range(m):  # k-means first, from rows spread over the sorted sample
        v = xs[:, s]
        order = np.lexsort((v[:, 1], v[:, 0])) if SUB > 1 else np.argsort(v[:, 0])
        c = v[order[np.linspace(0, n - 1, CODES).astype(int)]].copy()
        for _ in range(10):
            at = ((v[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            for k in range(CODES):
                if (at == k).any():
                    c[k] = v[at == k].mean(0)
        books[s] = c
    rows = np.arange(n)
    for _ in range(rounds):
        codes = encode(x, books, 2, eta)
        approx = books[np.arange(m)[None], codes]
        parallel = ((xs - approx) * xs).sum((1, 2))
        for s in range(m):
            # Given the other subspaces, each codeword solves a weighted least squares of SUB unknowns.
            rest = parallel - ((xs[:, s] - approx[:, s]) * xs[:, s]).sum(1)
            goal = rest + (xs[:, s] ** 2).sum(1)
            for k in range(CODES):
                own = rows[codes[:, s] == k]
                if len(own):
                    v = xs[own, s]
                    a = len(own) * np.eye(SUB) + (eta - 1) * v.T @ v
                    b = v.sum(0) + (eta - 1) * (goal[own, None] * v).sum(0)
                    books[s, k] = np.linalg.solve(a, b)
            new = books[s][codes[:, s]]
            parallel = rest + ((xs[:, s] - new) * xs[:, s]).sum(1)
            approx[:, s] = new
    return books


def table_scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate inner products (queries, rows): each query's tables hold its products with all codewords."""
    tables = np.einsum("qsd,skd->qsk", _cut(queries), books).astype(np.float32)
    out = np.zeros((len(queries), len(codes)), dtype=np.float32)
    for s in range(tables.shape[1]):
        out += tables[:, s, :][:, codes[:, s]]
    return out


def _angles(xn: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each unit row: the length of its decoded vector, and cosine and sine of the angle between the two."""
    length, along, across = np.zeros(len(xn)), np.zeros(len(xn)), np.ones(len(xn))
    for at in range(0, len(xn), 2048):
        x = xn[at : at + 2048]
        y = books[np.arange(len(books))[None], codes[at : at + 2048]].reshape(len(x), -1)[:, : x.shape[1]]
        size = np.linalg.norm(y, axis=1)
        u = y / np.where(size > 0, size, 1.0)[:, None]
        cos = (x * u).sum(1)
        length[at : at + 2048], along[at : at + 2048], across[at : at + 2048] = size, cos, np.linalg.norm(x - cos[:, None] * u, axis=1)
    return length, along, across


def _most(approx: np.ndarray, length: np.ndarray, along: np.ndarray, across: np.ndarray, slack: float) -> np.ndarray:
    """The largest cosine that a row can have with a query, given the table's product of the two.

    The decoded vector is at a known angle from the row and at one, known but for the tables'
    rounding, from the query: the row is nearest to the query at the difference of the two.
    """
    known = length > 0
    size = np.where(known, length, 1.0)
    c = approx / size
    c = np.clip(np.clip(along, c - slack / size, c + slack / size), -1.0, 1.0)
    return np.where(known, c * along + np.sqrt(1.0 - c * c) * across, 1.0) + MARGIN


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, books: np.ndarray, k: int, rerank: int = RERANK, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, cosines): for each query the best k of a block's rows, which must be sorted by id. codes: of the rows, if they are known."""
    qn, xn = unit(q), unit(x)
    if codes is None:
        codes = np.concatenate([encode(xn[at : at + 2048], books) for at in range(0, len(xn), 2048)])
    # Padding of an odd dimension is zero in the query, so the decoded vector's last number there plays no part.
    length, along, across = _angles(xn, codes, books)
    # A sum of m single-precision products of two vectors is off by m + 2 roundings of the product of their lengths at most.
    slack = (len(books) + 2) * float(np.finfo(np.float32).eps) * (1.0 + float(length.max(initial=0.0)))
    out_q, out_i, out_s = [], [], []
    take = min(rerank + k, len(ids))
    for at in range(0, len(q), 64):
        approx = table_scan(qn[at : at + 64], codes, books)
        other = ids[None, :] != q_ids[at : at + 64, None]
        approx[~other] = -np.inf
        least = np.full(len(approx), -np.inf)  # the k-th exact cosine among the rows that the tables put first
        if take < len(ids):
            some = np.argpartition(approx, len(ids) - take, axis=1)[:, len(ids) - take :]
            for j in range(len(approx)):
                own = some[j][other[j, some[j]]]
                if len(own) >= k:
                    least[j] = np.partition(xn[own] @ qn[at + j], len(own) - k)[len(own) - k]
        # Every row that may reach it is scored; the rest cannot be among the best k.
        maybe = other & (_most(np.where(other, approx, 0.0), length, along, across, slack) >= least[:, None])
        columns = np.flatnonzero(maybe.any(axis=0))
        scored = qn[at : at + 64] @ xn[columns].T
        for j in range(len(approx)):
            some = np.flatnonzero(maybe[j, columns])
            if len(some) > k:
                row = scored[j, some]
                some = some[row >= np.partition(row, len(row) - k)[len(row) - k] - MARGIN]
            some = columns[some]
            exact = np.minimum(1.0, np.maximum(-1.0, cosines(q[at + j], x[some])))
            best = np.lexsort((ids[some], -exact))[:k]
            out_q += [q_ids[at + j]] * len(best)
            out_i += ids[some[best]].tolist()
            out_s += exact[best].tolist()
    return np.array(out_q, dtype=np.int64), np.array(out_i, dtype=np.int64), np.array(out_s, dtype=float)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines in double precision. Sums run row by row, so that equal vectors have equal scores wherever they lie."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))


def fit(valid: DataFrame, dim: int) -> np.ndarray:
    """Codebooks from a bounded sample: the SAMPLE_ROWS rows with the smallest hash of their id."""
    ids = F.broadcast(bounded_sample_ids(valid.select("vec_id"), "vec_id", SAMPLE_ROWS))
    got = valid.join(ids, "vec_id", "left_semi").orderBy("vec_id").limit(SAMPLE_ROWS).toPandas()
    return fit_codebooks(unit(np.stack(got["v"].to_numpy()).astype(float).reshape(len(got), dim)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. is_query: which rows are queries (on vec_id)."""
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, id_col, vector_col)
    schema = "query_id long, vec_id long, score double"
    dims = valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = dims[0]["d"], dims[0]["n"]
    valid = checkpointed(valid.where(F.size("v") == dim))
    n_queries = valid.where(is_query).count()
    books = spark.sparkContext.broadcast(fit(valid, dim))  # 16 codewords a subspace, whatever the table's size
    n_blocks, q_blocks = max(1, math.ceil(n / min(BLOCK_ROWS, max(LEAST_ROWS, n // 256)))), max(1, math.ceil(n_queries / QUERY_ROWS))
    slot = F.xxhash64("vec_id")
    block, q_block = F.pmod(slot, F.lit(n_blocks)).cast("int"), F.pmod(F.shiftright(slot, 20), F.lit(q_blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    m = math.ceil(dim / SUB)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                x = unit(np.stack(part["v"].to_numpy()).astype(float))
                yield part.assign(code=pack(encode(x, books.value)))

    small_batches(spark)
    coded = valid.mapInPandas(code, "vec_id long, v array<double>, code binary")
    rows = coded.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block.alias("b"), "vec_id", "v", "code")
    asking = valid.where(is_query).select(q_block.alias("qb"), F.explode(every).alias("b"), "vec_id", "v", F.lit(None).cast("binary").alias("code"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable", ignore_index=True)
        asks = pdf["code"].isna().to_numpy()
        if not asks.any() or asks.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, ids = np.stack(pdf["v"].to_numpy()).astype(float), pdf["vec_id"].to_numpy(np.int64)
        own, first = np.unique(ids[asks], return_index=True)  # rows that repeat a query's id ask once
        q, i, s = search_block(own, x[asks][first], ids[~asks], x[~asks], books.value, k, rerank, unpack(pdf["code"][~asks].tolist(), m))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    found = rows.unionByName(asking).groupBy("qb", "b").applyInPandas(run, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    total = exact.count()
    return found.join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0

