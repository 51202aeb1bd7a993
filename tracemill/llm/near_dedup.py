"""MinHash near-dedup (operator 5): a signature-coordinate inverted join.

1. Every text becomes the set of its distinct word shingles, as 64-bit hashes,
   and a MinHash signature of COORDINATES values. Texts with equal sets meet in
   one representative (the smallest id) before anything else.
2. Representatives are posted under each (coordinate, value). Values that only
   one representative has cannot collide and go at once. A pair must collide in
   at least `match_threshold` coordinates (a link at the similarity threshold
   has fewer in one of a million cases; need=1 keeps every pair that collides at
   all), so who has fewer values left goes too, and of each representative's
   values the match_threshold - 1 most frequent are skipped: what is left is its
   prefix, the rarest ones, and any pair that collides often enough shares the
   rarest common value in both prefixes.
3. In lists of up to DENSE rows a pair is counted, on all coordinates and whole
   values, in the list of its rarest common value only, and kept if it reaches
   the match threshold. Candidates are confirmed on the full sets; those that
   confirmed links of their list connect already are skipped.
4. Longer lists (large groups of near copies) never write out their pairs. A few
   of a list's rows, its pivots, are compared with all rows whose longest list it
   is; links join rows. A list whose rows are all joined is done. In the others the
   rows outside the largest joined part, which more rounds of pivots make few,
   meet all rows in tiles of about BLOCK by BLOCK rows, where pairs that are
   joined already are skipped. This loses no component.
5. Components by alternating large-star and small-star steps.

Defined results: texts without words, empty and null ones have the empty set
and are linked with nothing; texts with fewer words than a shingle have their
whole word sequence as one shingle; rows that share an id count as one document,
and its texts as linked; rows without an id join the component of their equal
texts and are never its name; an empty table gives no rows; other columns are
ignored. Letters other than A-Z keep their case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, checkpointed, shuffle_parts, small_batches, unused, written

COORDINATES = 64
#: Share of links at the threshold that the count may miss.
MISS = 1e-6
#: Rows of a long list that meet in one tile are twice this, on average.
BLOCK = 512
#: Rows of a list from which it counts as long.
DENSE = 64
#: Pivots of a long list in a round, and rounds at most: another one is made while tiles would copy each row more than COPIES times and the last one halved that.
PIVOTS, ROUNDS, COPIES = 3, 4, 4
#: Ids are sent to all executors up to this many (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Rank of a coordinate whose value no other representative has.
GONE = 255
#: Words whose hash a worker keeps.
CACHE_WORDS = 100_000
_P = np.uint64(0x9E3779B97F4A7C15)
_A = (np.random.default_rng(20240229).integers(1, 2**63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_words: dict[bytes, int] = {}


def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of collisions that a pair at the similarity misses with probability `miss` at most."""
    below, t = 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, only ASCII white space splits
    if not split:
        return np.zeros(0, dtype=np.uint64)
    own = _words
    if len(own) > CACHE_WORDS:
        own.clear()
    h = np.empty(len(split), dtype=np.uint64)
    for i, w in enumerate(split):
        v = own.get(w)
        if v is None:
            v = own[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    n = min(words, len(split))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s = (s ^ h[k : len(h) - n + 1 + k]) * _P
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest value of each coordinate's hash, upper 32 bits."""
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(low, np.multiply.outer(s[at : at + 512], _A).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the set; null if empty), sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                n, h1, h2, sig = [], [], [], []
                for text in part["text"]:
                    s = shingles(text, words)
                    n.append(len(s))
                    if len(s):
                        d = xxhash.xxh128_digest(s.tobytes())
                        h1.append(int.from_bytes(d[:8], "little", signed=True))
                        h2.append(int.from_bytes(d[8:], "little", signed=True))
                        sig.append(signature(s).view(np.int32))
                    else:
                        h1.append(None)
                        h2.append(None)
                        sig.append(None)
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_shingles": np.array(n, dtype=np.int64), "h1": pd.array(h1, dtype="Int64"), "h2": pd.array(h2, dtype="Int64"), "sig": sig})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, sig array<int>")


def representatives(base: DataFrame) -> DataFrame:
    """h1, h2, rep (the smallest id; null if no row has one), other, n, sig: a row for each set. rep and other name a set that has an id.

    Equal sets have equal signatures, so any row's will do. Only where several sets have one rep, `other` is h1, else 0:
    names are sent with every value of a signature, and zeros take no room.
    """
    sets = written(base.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    shared = written(sets.where("rep IS NOT NULL").groupBy("rep").agg(F.count("*").alias("sets")).where("sets > 1"))
    return sets.join(shared, "rep", "left").withColumn("other", F.when(F.col("sets").isNotNull(), F.col("h1")).otherwise(F.lit(0).cast("long"))).drop("sets")


def survivors_of(reps: DataFrame, need: int) -> DataFrame:
    """rep, h1, n, have: representatives with at least `need` values that others have too, and those values with their frequencies."""
    name = ["rep", "other"]
    tokens = reps.select(*name, F.posexplode("sig").alias("coord", "v")).select(*name, F.shiftleft(F.col("coord").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    left = tokens.join(counts, "token").groupBy(*name).agg(F.collect_list(F.struct("df", "token")).alias("have")).where(F.size("have") >= need)
    return left.join(reps.select(*name, "h1", "n"), name).select("rep", "h1", "n", "have")


_POST = "token long, df long, coord int, rep long, h1 long, n long, vec binary"


def posts_of(survivors: DataFrame, need: int, dense: bool) -> DataFrame:
    """Postings of the prefixes in long lists or in the others: token, df (the list's rows), coord, rep, h1, n, vec (values and ranks by coordinate)."""
    limit = DENSE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for rep, h1, n, have in zip(pdf["rep"], pdf["h1"], pdf["n"], pdf["have"], strict=True):
                have = sorted((int(x["df"]), int(x["token"])) for x in have)
                prefix = [x for x in have[: len(have) - need + 1] if (x[0] > limit) == dense]
                if not prefix:
                    continue
                v = np.zeros(COORDINATES, dtype="<u4")
                rank = np.full(COORDINATES, GONE, dtype=np.uint8)  # coordinates that are gone collide with none
                for r, (_, token) in enumerate(have):
                    v[token >> 32] = token & 0xFFFFFFFF
                    rank[token >> 32] = r
                vec = v.tobytes() + rank.tobytes()
                out += [(token, df, token >> 32, rep, h1, n, vec) for df, token in prefix]
            yield pd.DataFrame(out, columns=["token", "df", "coord", "rep", "h1", "n", "vec"])

    return survivors.mapInPandas(run, _POST)


class _Groups:
    """Hands out the runs of rows with equal keys from sorted batches; a run may go over several batches."""

    def __init__(self, batches: Iterator[pd.DataFrame], keys: list[str]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """(rows, starts): whole runs only; starts holds where each begins, and the end."""
        rest: list[pd.DataFrame] = []
        for pdf in self.batches:
            if not len(pdf):
                continue
            rest.append(pdf)
            last = tuple(pdf[k].iat[-1] for k in self.keys)
            if tuple(pdf[k].iat[0] for k in self.keys) == last and (len(rest) == 1 or tuple(rest[0][k].iat[-1] for k in self.keys) == last):
                continue  # the whole batch continues one run
            every = pd.concat(rest, ignore_index=True) if len(rest) > 1 else pdf.reset_index(drop=True)
            starts = self._starts(every)
            cut = int(starts[-2])
            rest = [every.iloc[cut:]]
            if cut:
                yield every.iloc[:cut], starts[:-1]
        if rest:
            every = pd.concat(rest, ignore_index=True)
            yield every, self._starts(every)

    def _starts(self, pdf: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        for k in self.keys:
            v = pdf[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), len(pdf))


def _collide(v: np.ndarray, rank: np.ndarray, coord: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, need: int, percent: int) -> np.ndarray:
    """Collisions of the pairs (a, b) that reach `need`, are counted in this list, and whose set sizes allow a link; else 0."""
    out = np.zeros(len(a), dtype=np.int16)
    real = rank != GONE
    fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    some = np.flatnonzero(fits)
    for at in range(0, len(some), 8192):
        i = some[at : at + 8192]
        x, y = a[i], b[i]
        same = (v[x] == v[y]) & real[x] & real[y]
        hits = same.sum(axis=1)
        first = np.where(same, rank[x], GONE).min(axis=1)  # the rarest common value
        out[i] = np.where((hits >= need) & (first == rank[x, coord[x]]), hits, 0)
    return out


def _vectors(vec: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Values and ranks of posted rows."""
    rows = np.frombuffer(b"".join(vec), dtype=np.uint8).reshape(len(vec), 5 * COORDINATES)
    return np.ascontiguousarray(rows[:, : 4 * COORDINATES]).view("<u4"), rows[:, 4 * COORDINATES :]


def candidates(posts: DataFrame, need: int, percent: int) -> DataFrame:
    """token, rep, h1, partners (place in the list's rows here), hits: for each row of a list the rows it collides with often enough; rows that are only partners have none."""
    parts = max(1, shuffle_parts(posts.sparkSession))
    laid = posts.repartition(parts, "token").sortWithinPartitions("token", "rep", "h1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _Groups(batches, ["token"]):
            v, rank = _vectors(rows["vec"])
            token, coord, n, rep = (rows[k].to_numpy(np.int64) for k in ("token", "coord", "n", "rep"))
            h1 = rows["h1"].to_numpy(np.int64)
            pend_a, pend_b, pending = [], [], 0

            def settle() -> pd.DataFrame | None:
                a, b = np.concatenate(pend_a), np.concatenate(pend_b)
                hits = _collide(v, rank, coord, n, a, b, need, percent)
                ok = hits > 0
                a, b, hits = a[ok], b[ok], hits[ok]
                if not len(a):
                    return None
                cuts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                alone = np.setdiff1d(b, a)
                first = np.concatenate((a[cuts], alone))
                none = [np.zeros(0, dtype=np.int64)] * len(alone)
                return pd.DataFrame({"token": token[first], "rep": rep[first], "h1": h1[first], "partners": [*np.split(rep[b], cuts[1:]), *none], "partner_sets": [*np.split(h1[b], cuts[1:]), *none], "hits": [*(h.astype(np.int32) for h in np.split(hits, cuts[1:])), *none]})

            for g in range(len(starts) - 1):
                s, e = starts[g], starts[g + 1]
                a, b = np.triu_indices(e - s, 1)
                if len(a):
                    pend_a.append(a + s)
                    pend_b.append(b + s)
                    pending += len(a)
                if pending > 200_000:
                    if (got := settle()) is not None:
                        yield got
                    pend_a, pend_b, pending = [], [], 0
            if pending and (got := settle()) is not None:
                yield got

    return laid.mapInPandas(run, "token long, rep long, h1 long, partners array<long>, partner_sets array<long>, hits array<int>")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on sorted distinct hashes."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def sets_of(docs: DataFrame, base: DataFrame, found: DataFrame, dense: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """rep, h1, grams: the sets of the rows whose id is a rep of found, and of dense; rows that repeat an id and its text have one."""
    asked = found.select("rep", F.lit(False).alias("long")).unionByName(dense.select("rep", F.lit(True).alias("long"))).groupBy("rep").agg(F.bool_or(~F.col("long")).alias("in_found"), F.bool_or("long").alias("in_dense"))
    often = base.groupBy(F.col("doc_id").alias("rep")).agg(F.count("*").alias("rows")).where("rows > 1").select("rep", F.lit(True).alias("again"))
    needed = written(asked.join(often, "rep", "left").withColumn("again", F.coalesce("again", F.lit(False))))
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(needed, "rep")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                grams = [shingles(t, words).astype("<u8").tobytes() for t in part["text"]]
                yield part.drop(columns="text").assign(h1=[int.from_bytes(xxhash.xxh128_digest(g)[:8], "little", signed=True) for g in grams], grams=grams)

    sets = checkpointed(texts.mapInPandas(cut, "rep long, in_found boolean, in_dense boolean, again boolean, h1 long, grams binary"))
    # Only rows whose id is repeated are sent anywhere to become one.
    once = sets.where("NOT again").unionByName(sets.where("again").dropDuplicates(["rep", "h1"]))
    return tuple(once.where(of).select("rep", "h1", "grams") for of in ("in_found", "in_dense"))


class _Joined:
    """Components within one task: links are confirmed only between nodes that are still apart."""

    def __init__(self, percent: int):
        self.percent, self.root, self.links = percent, {}, []

    def find(self, x: int) -> int:
        root = self.root
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    def link(self, a: int, b: int, x: int, y: int, own: np.ndarray, other: np.ndarray) -> None:
        """Documents a and b of the components x and y."""
        p, q = self.find(x), self.find(y)
        if p != q and _linked(own, other, self.percent):
            self.root[max(p, q)] = min(p, q)
            self.links.append((a, b))


def confirm(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: confirmed links that connect what all confirmed links of the candidates connect, list by list."""
    parts = max(1, shuffle_parts(found.sparkSession))
    laid = found.join(sets, ["rep", "h1"]).repartition(parts, "token").sortWithinPartitions("token")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _Groups(batches, ["token"]):
            links = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = rows.iloc[s:e]
                own = {(r, h): np.frombuffer(g, dtype="<u8") for r, h, g in zip(part["rep"], part["h1"], part["grams"], strict=True)}
                pairs = [(-int(hit), int(r), int(h), int(p), int(q)) for r, h, ps, qs, hits in zip(part["rep"], part["h1"], part["partners"], part["partner_sets"], part["hits"], strict=True) for p, q, hit in zip(ps, qs, hits, strict=True)]
                joined = _Joined(percent)
                for _, r, h, p, q in sorted(pairs):  # the likeliest first: most of the others are then connected already
                    joined.link(r, p, r, p, own[r, h], own[p, q])
                links += joined.links
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return laid.mapInPandas(run, "a long, b long")


def _blocks(rows: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK)).cast("int")


def _block_of(blocks: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64("rep", "h1", F.lit(seed)), blocks.cast("long")).cast("int")


def _upto(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def pivot_links(asked: DataFrame, pivots: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """a, b: confirmed links of rows (asked: one list each) with the list's pivots (token, df, p). A pivot is sent once for every BLOCK rows, so that no task holds a whole list."""
    p, keys = F.col("p"), ["token", "own"]
    cols = [*keys, "rep", "h1", "n", "vec", "is_pivot"]
    spread = pivots.select("token", _upto(_blocks("df")).alias("own"), "df", p["rep"].alias("rep"), p["h1"].alias("h1"), p["n"].alias("n"), p["vec"].alias("vec"), F.lit(True).alias("is_pivot"))
    parts = max(1, shuffle_parts(asked.sparkSession))
    met = asked.select("token", _block_of(_blocks("df"), 1).alias("own"), "df", "rep", "h1", "n", "vec", F.lit(False).alias("is_pivot")).unionByName(spread).select(*cols, "df")
    laid = met.repartition(parts, *keys).sortWithinPartitions(*keys)

    def collide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _Groups(batches, keys):
            v, rank = _vectors(rows["vec"])
            rep, h1, n, df = (rows[k].to_numpy(np.int64) for k in ("rep", "h1", "n", "df"))
            is_pivot, out = rows["is_pivot"].to_numpy(bool), []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                members, chosen = s + np.flatnonzero(~is_pivot[s:e]), s + np.flatnonzero(is_pivot[s:e])
                for q in chosen:
                    fits = 100 * np.minimum(n[members], n[q]) >= percent * np.maximum(n[members], n[q])
                    some = members[fits & ((rep[members] != rep[q]) | (h1[members] != h1[q]))]
                    hits = ((v[some] == v[q]) & (rank[some] != GONE) & (rank[q] != GONE)).sum(axis=1)
                    some = some[hits >= need]
                    out.append(pd.DataFrame({"rep": rep[some], "h1": h1[some], "p_rep": rep[q], "p_h1": h1[q], "p_df": df[q]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    pairs = laid.mapInPandas(collide, "rep long, h1 long, p_rep long, p_h1 long, p_df long")
    # A pivot's set is sent once for every BLOCK rows of its list.
    p_sets = sets.select(F.col("rep").alias("p_rep"), F.col("h1").alias("p_h1"), F.col("grams").alias("p_grams"))
    p_sets = pivots.select(p["rep"].alias("p_rep"), p["h1"].alias("p_h1"), F.col("df").alias("p_df")).distinct().join(p_sets, ["p_rep", "p_h1"]).withColumn("own", _upto(_blocks("p_df")))
    both = pairs.withColumn("own", _block_of(_blocks("p_df"), 2)).join(sets, ["rep", "h1"]).join(p_sets, ["p_rep", "p_h1", "p_df", "own"]).select("rep", "p_rep", "grams", "p_grams")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [_linked(np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8"), percent) for x, y in zip(pdf["grams"], pdf["p_grams"], strict=True)]
            out = pdf[["rep", "p_rep"]][np.array(ok, dtype=bool)]
            yield out.rename(columns={"rep": "a", "p_rep": "b"})

    return both.mapInPandas(check, "a long, b long")


def _near_roots(links: DataFrame) -> DataFrame:
    """node, root: of the pivots that links lead to the one with the most links, in up to four steps. Nodes with one root are connected; not all connected nodes have one root."""
    both = links.unionByName(links.select(F.col("b").alias("a"), "b").distinct())
    weights = written(links.groupBy("b").agg(F.count("*").alias("n")))
    roots = written(both.join(weights, "b").groupBy(F.col("a").alias("node")).agg(F.max_by("b", F.struct("n", "b")).alias("root")))
    for _ in range(2):
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = written(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return roots


def _apart(names: DataFrame, roots: DataFrame) -> DataFrame:
    """token, rep, h1, df, comp, minor, n_minor: rows of lists that hold several components; minor ones are not in the list's largest. names: rep, h1, lists (token, df)."""
    known = names.join(roots, names["rep"] == roots["node"], "left").select("rep", "h1", F.coalesce("root", "rep").alias("comp"), F.inline("lists"))
    sizes = known.groupBy("token", "df", "comp").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("token", "df").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("n_major"), F.count("*").alias("comps")).where("comps > 1")
    # Each list's largest component is sent once for every BLOCK of its rows.
    spread = lists.select("token", _upto(_blocks("df")).alias("own"), "major", (F.col("all") - F.col("n_major")).alias("n_minor"))
    met = known.withColumn("own", _block_of(_blocks("df"), 1)).join(spread, ["token", "own"])
    return met.select("token", "rep", "h1", "df", "comp", (F.col("comp") != F.col("major")).alias("minor"), "n_minor")


def tile_links(dense: DataFrame, apart: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """a, b: confirmed links between the components of a list. Its minor rows meet all of its rows in tiles."""
    rows = dense.drop("df").join(apart, ["token", "rep", "h1"]).join(sets, ["rep", "h1"])
    # A row is asked in its own block by every block of minor rows; a minor row asks in all blocks.
    asked = F.transform(F.sequence(F.lit(0), _blocks("n_minor") - 1), lambda i: F.struct(i.alias("bi"), _block_of(_blocks("df"), 1).alias("bj"), F.lit(False).alias("asks")))
    asking = F.transform(F.sequence(F.lit(0), _blocks("df") - 1), lambda j: F.struct(_block_of(_blocks("n_minor"), 3).alias("bi"), j.alias("bj"), F.lit(True).alias("asks")))
    cols, keys = ["token", "coord", "rep", "h1", "n", "vec", "comp", "minor", "grams"], ["token", "bi", "bj"]
    parts = max(1, shuffle_parts(dense.sparkSession))
    laid = rows.select(*cols, F.explode(F.when(F.col("minor"), F.concat(asked, asking)).otherwise(asked)).alias("at")).select(*cols, "at.*").repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for every, starts in _Groups(batches, keys):
            links = []
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                part = every.iloc[s:e]
                v, rank = _vectors(part["vec"])
                coord, n, rep, h1, comp = (part[k].to_numpy(np.int64) for k in ("coord", "n", "rep", "h1", "comp"))
                minor, asks, grams = part["minor"].to_numpy(bool), part["asks"].to_numpy(bool), part["grams"].to_numpy()
                one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
                joined = _Joined(percent)
                step = max(1, 65_536 // max(1, len(two)))
                for at in range(0, len(one), step):
                    i, j = np.repeat(one[at : at + step], len(two)), np.tile(two, len(one[at : at + step]))
                    # Two minor rows meet in two tiles; the one whose asking row has the smaller name counts.
                    once = ~minor[j] | (rep[i] < rep[j]) | ((rep[i] == rep[j]) & (h1[i] < h1[j]))
                    some = once & (comp[i] != comp[j])
                    i, j = i[some], j[some]
                    hits = _collide(v, rank, coord, n, i, j, need, percent)
                    order = np.argsort(-hits, kind="stable")[: int((hits > 0).sum())]
                    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                        joined.link(int(rep[x]), int(rep[y]), int(comp[x]), int(comp[y]), np.frombuffer(grams[x], dtype="<u8"), np.frombuffer(grams[y], dtype="<u8"))
                links += joined.links
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return laid.mapInPandas(run, "a long, b long")


def dense_links(dense: DataFrame, sets: DataFrame, need: int, percent: int) -> DataFrame:
    """a, b: confirmed links that connect what all links within long lists connect."""
    n_rows = dense.count()
    links = dense.sparkSession.createDataFrame([], "a long, b long")
    if not n_rows:
        return links
    names = written(dense.groupBy("rep", "h1").agg(F.collect_list(F.struct("token", "df")).alias("lists")))  # 64 lists a row at most
    apart, before = None, 0
    for at in range(ROUNDS):
        # A row meets the pivots of one list, its longest: where it is still apart, after the first round.
        rows = dense if apart is None else dense.drop("df").join(apart.select("token", "rep", "h1", "df", "minor"), ["token", "rep", "h1"])
        asked = written(rows.groupBy("rep", "h1").agg(F.max_by(F.struct(*rows.columns), F.struct("df", "token")).alias("x")).select("x.*"))
        # All lists choose among all of their rows by one order, so that lists with much in common have the same pivots.
        by = F.xxhash64("rep", "h1", F.lit(at))
        among = dense if apart is None else apart.where("minor")
        chosen = among.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token", "df", F.pmod(by, F.lit(PIVOTS))).agg(F.min_by(F.struct("rep", "h1"), by).alias("p")).select("token", "df", "p.rep", "p.h1")
        pivots = written(chosen.join(dense.select("token", "rep", "h1", "n", "vec"), ["token", "rep", "h1"]).select("token", "df", F.struct("rep", "h1", "n", "vec").alias("p")))
        links = written(links.unionByName(pivot_links(asked, pivots, sets, need, percent)))
        apart = written(_apart(names, _near_roots(links)))
        names = written(apart.groupBy("rep", "h1").agg(F.collect_list(F.struct("token", "df")).alias("lists")))
        copies = apart.agg(F.sum(_blocks("n_minor") + F.when(F.col("minor"), _blocks("df")).otherwise(0)).alias("n")).collect()[0]["n"]
        if not copies:
            return links
        if copies <= COPIES * n_rows or before and 2 * copies > before:
            break
        before = copies
    if apart is None:
        apart = dense.select("token", "rep", "h1", "df", F.col("rep").alias("comp"), F.lit(True).alias("minor"), F.col("df").alias("n_minor"))
    return links.unionByName(tile_links(dense, apart, sets, need, percent))


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that links lead to, for every node that has a link."""
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = written(links.where(F.col("a") != F.col("b")).select(hi, lo).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).collect()[0])
        if now == state or now[0] == 0:
            break
        state = now
        # Large star: a node's larger neighbours go to its smallest neighbour.
        both = edges.select(F.col("hi").alias("n"), F.col("lo").alias("m")).unionByName(edges.select(F.col("lo").alias("n"), F.col("hi").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("least", "n").alias("least"))
        large = both.join(least, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("hi"), F.col("least").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").where(F.col("lo") != F.col("least")).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        edges = written(small.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct())
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", need: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (whether that is the row's own id).

    need: collisions that a pair must have (default: match_threshold, which a link has but once in a million); 1 is the
    exact way, for which all pairs that collide at all are confirmed: a link at the threshold then has none with a
    probability of (1 - percent / 100) ** 64.
    """
    if words < 1 or not 0 < percent <= 100:
        raise ValueError("words must be positive and percent in 1..100")
    small_batches(docs.sparkSession)
    need = match_threshold(percent / 100) if need is None else need
    base = checkpointed(signatures(docs, words, id_col, text_col))
    every = representatives(base)
    groups = every.select("h1", "h2", "rep")
    left = checkpointed(survivors_of(every.where("rep IS NOT NULL"), need))
    found = checkpointed(candidates(posts_of(left, need, False), need, percent))
    dense = checkpointed(posts_of(left, need, True))
    in_found, in_dense = sets_of(docs, base, found, dense, words, id_col, text_col)
    links = confirm(found, in_found, percent).unionByName(dense_links(dense, in_dense, need, percent))
    # Rows that share an id are one document: its sets' representatives are linked.
    shared = base.where("n_shingles > 0 AND doc_id IS NOT NULL").join(groups, ["h1", "h2"]).where(F.col("doc_id") != F.col("rep")).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a != b").select("a", "b")
    roots = components(links.unionByName(shared))
    named = groups.join(roots, groups["rep"] == roots["node"], "left").select("h1", "h2", F.coalesce("root", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, with one document of each component left.

    Rows without an id are documents by their text: they go if their component has a document with an id, else one
    stays. Of rows that share an id the one with the smallest hash of its text stays. Texts without words all stay,
    but for rows that repeat an id.
    """
    own = list(docs.columns)
    name, gone_id, twice, least, rows = unused(own, "_name", "_gone", "_twice", "_least", "_rows")
    text = F.col("text").cast("string")
    # Names for rows without an id: above any id that counts up, so that documents with ids stay.
    named = docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), F.when(text.rlike(WORD), F.lit(2**62) + F.shiftrightunsigned(F.xxhash64(text), 2))))
    gone = checkpointed(near_duplicates(named.select(name, "text"), words, percent, id_col=name).where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias(gone_id)).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = named.join(gone, F.col(name) == F.col(gone_id), "left_anti")
    # Rows that repeat an id: one of them stays.
    again = checkpointed(left.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(twice)).agg(F.count("*").alias(rows), F.min(F.xxhash64("text")).alias(least)).where(F.col(rows) > 1).drop(rows))
    if again.count() == 0:
        return left.drop(name)
    once = left.join(again, F.col(name) == F.col(twice), "left").where(F.col(twice).isNull() | (F.xxhash64("text") == F.col(least))).drop(least)
    kept = once.where(F.col(twice).isNull()).unionByName(once.where(F.col(twice).isNotNull()).dropDuplicates([name]))
    return kept.drop(name, twice)
