"""Document fingerprints (operator 6): SpotSigs, with DataFrame functions only.

A text is lower-cased and cut into words. Every common word (ANCHORS) opens a
chain: the anchor and the CHAIN content words that follow it, other anchors
skipped. A text's fingerprint is the sorted set of its chains' hashes. The start
of a text is an anchor too, so that every text has a signature. Likeness is the
Jaccard index of two sets.

`near_pairs` joins a collection with itself: equal sets meet once, sets are
partitioned by length, a pair is compared only if the shorter set is at least
threshold times as long as the longer one, and only pairs that share one of the
rarest hashes of both (prefix filter) are compared at all; lists of such a hash
that are long are cut into bounded blocks.

Defined results: null text is empty; an empty text has the signature of an
empty chain; equal texts have equal fingerprints; rows that share an id are
ordered by their text's hash; a null id sorts last in descending order; an empty
table gives no rows; other columns are ignored. Rows equal in id and text lie in
one range, however many they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.common import shuffle_parts

#: Common words of English, German, French and Spanish that open a chain.
ANCHORS = (
    "a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "avec", "dans", "des", "du", "est", "et", "la", "le", "les", "par", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "de", "del", "el", "en", "las", "los", "para", "por", "se", "su", "una", "y",
)
CHAIN = 2
_LOWEST = -(2**63)
_CUTS = 512
#: Texts that one range of ids holds, about.
RANGE_BYTES = 128 * 2**20


def _anchor_pattern() -> str:
    """The anchors as one alternation, by first letter, so that few are tried at each word."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(ANCHORS), key=lambda w: (w[0], -len(w), w)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join([r"\^", *(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())])


def chains(tokens: Column) -> Column:
    """Sorted distinct hashes of the chains. tokens: words, each with the anchors before it joined by |."""

    def content(i: Column) -> Column:
        return F.coalesce(F.substring_index(F.get(tokens, i), "|", -1), F.lit(""))

    def at(token: Column, i: Column) -> Column:
        after = [content(i + k) for k in range(1, CHAIN)]
        opened = F.split(token, r"\|")
        own = F.element_at(opened, -1)
        return F.when(F.contains(token, F.lit("|")), F.transform(F.slice(opened, 1, F.size(opened) - 1), lambda a: F.hash(a, own, *after)))

    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(tokens, at), lambda x: x.isNotNull()))))


def tokens_of(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    joined = F.regexp_replace(F.concat(F.lit("^ "), words, F.lit(" ")), rf"(?<![^ ])({_anchor_pattern()}) ", "$1|")
    return F.split(F.rtrim(joined), " ")


def with_signatures(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the sorted set of signature hashes of a text column. The tokens are a column of their own, so that they are made once."""
    tokens = f"_tokens_{out}"
    return df.withColumn(tokens, tokens_of(F.col(text_col))).withColumn(out, chains(F.col(tokens))).drop(tokens)


def fingerprint_string(signatures: Column) -> Column:
    return F.concat_ws("", F.transform(signatures, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, signatures of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_signatures(rows, "text", "signatures")


def _bucket(order: Column, cuts: list[int], parts: int) -> Column:
    """The range of ids a row belongs to: a binary search over the cuts, then equal parts between two cuts."""

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid, hi))

    if len(cuts) < 2:
        return F.lit(0).cast("long")
    i = search(0, len(cuts))
    if parts == 1:
        return i.cast("long")
    edges = F.array(*[F.lit(c) for c in cuts])
    lo, hi = F.get(edges, i).cast("double"), F.coalesce(F.get(edges, i + 1), F.get(edges, i)).cast("double")
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((order.cast("double") - lo) * parts / F.greatest(hi - lo, F.lit(1.0)))))
    return (i * parts + part).cast("long")


def with_next(signed: DataFrame) -> DataFrame:
    """Add text and signatures of the next row by descending doc_id (after the last: the first).

    Rows are dealt into ranges of ids, two a shuffle partition or one for RANGE_BYTES of text, whichever are more; an
    id that fills ranges alone (rows without an id, for one) is cut by its texts' hashes. Within a range the next row
    is a window's lead; the last row of a range gets the first of the range below. One shuffle carries the texts.
    """
    spark = signed.sparkSession
    order = F.coalesce(F.col("doc_id"), F.lit(_LOWEST))
    size = signed.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("b")).collect()[0]["b"]
    n_parts = max(1, shuffle_parts(spark), math.ceil(size / (2 * RANGE_BYTES)))
    n_buckets = 2 * n_parts
    n_cuts = min(_CUTS, n_buckets)
    found = signed.select(order.alias("o")).agg(F.percentile_approx("o", [i / n_cuts for i in range(n_cuts)], 20_000).alias("c")).collect()[0]["c"] or []
    cuts, parts = sorted(set(found)), math.ceil(n_buckets / n_cuts)
    # An id that several cuts fall on is a range's lowest. Its rows follow the range's others, in order of their hashes.
    hot = {c: found.count(c) * parts for c in cuts if found.count(c) > 1}
    most, tie = max(hot.values(), default=0), F.col("_t")
    at = F.floor((tie.cast("double") / float(2**64) + 0.5) * most).cast("long")
    under = F.when(F.col("_o").isin(list(hot)), F.least(F.lit(most - 1), F.greatest(F.lit(0), at))).otherwise(F.lit(-1)) if hot else F.lit(-1)
    bucket = (_bucket(F.col("_o"), cuts, parts) * (most + 1) + (F.lit(most - 1) - under)).cast("long")
    rows = signed.withColumn("_o", order).withColumn("_t", F.xxhash64("text")).withColumn("_b", bucket)
    # The first row of each range; there are as many as ranges, which the size of the texts bounds.
    firsts = rows.groupBy("_b").agg(F.min(F.struct(F.bitwise_not("_o").alias("o"), F.col("_t").alias("t"))).alias("f")).collect()
    down = sorted((r["_b"] for r in firsts), reverse=True)
    if not down:
        return signed.withColumn("next_text", F.lit("")).withColumn("next_signatures", F.col("signatures"))
    below = spark.createDataFrame([(b, down[(i + 1) % len(down)]) for i, b in enumerate(down)], "_b long, _under long")
    first_ids = F.broadcast(spark.createDataFrame([(r["_b"], ~r["f"]["o"], r["f"]["t"]) for r in firsts], "_b long, _o long, _t long"))
    # Their signatures are made after they are chosen, not for all rows once more.
    heads = with_signatures(rows.select("_o", "_t", "_b", "text").join(first_ids, ["_b", "_o", "_t"], "left_semi").dropDuplicates(["_b"]), "text", "signatures").select(F.col("_b").alias("_under"), F.struct("text", "signatures").alias("_head"))
    heads = below.join(heads, "_under").select(F.col("_b").alias("_hb"), "_head")
    w = Window.partitionBy("_b").orderBy(F.col("_o").desc(), tie)
    led = rows.repartition(n_parts, "_b").withColumn("_next", F.lead(F.struct("text", "signatures")).over(w))
    joined = led.join(heads, led["_b"] == heads["_hb"], "left")
    after = F.coalesce(F.col("_next"), F.col("_head"))
    return joined.select("doc_id", "text", "signatures", after["text"].alias("next_text"), after["signatures"].alias("next_signatures"))


def edited_text(text: Column, next_text: Column) -> Column:
    """The last third (rounded down) of the text replaced by the first as many code points of the next."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def likeness_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and how like they and the next text's are."""
    rows = with_next(fingerprints(docs, id_col, text_col))
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "signatures", "next_signatures", "edited")
    rows = with_signatures(rows, "edited", "edited_signatures")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint_string(F.col("signatures")).alias("fingerprint"), fingerprint_string(F.col("edited_signatures")).alias("edited_fingerprint"), jaccard(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), jaccard(F.col("signatures"), F.col("next_signatures")).alias("near_next"))


def near_pairs(signed: DataFrame, threshold: float = 0.8, block: int = 256) -> DataFrame:
    """a, b, likeness: pairs of representatives (smallest id of rows with equal sets) at or above the threshold, a < b.

    The members of a representative are the rows with its set; `fingerprint_string` of the set names it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    reps = signed.groupBy("signatures").agg(F.min("doc_id").alias("rep")).where(F.col("rep").isNotNull())
    each = reps.select("rep", F.size("signatures").alias("n"), F.explode("signatures").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("df"))
    ranked = each.join(counts, "h").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("by_rarity"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(threshold)).cast("int") + 1
    posts = ranked.select("rep", "n", F.explode(F.slice("by_rarity", 1, keep)).alias("x")).select("rep", "n", F.col("x.h").alias("h"), F.col("x.df").alias("df")).where(F.col("df") > 1)
    # Lengths that may match fall into the same or neighbouring classes, each 1 / threshold times the one below.
    step = math.log(1 / threshold) if threshold < 1 else 1.0
    cls = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)) if threshold < 1 else F.col("n").cast("long")
    blocks = F.ceil(F.col("df") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    left = posts.select("h", cls.alias("c"), F.col("rep").alias("a"), F.col("n").alias("na"), own.alias("ba"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("bb"))
    right = posts.select("h", "n", "rep", F.explode(F.array(cls, cls - 1) if threshold < 1 else F.array(cls)).alias("c"), own.alias("bb"), blocks.alias("blocks"))
    right = right.select("h", "c", F.col("rep").alias("b"), F.col("n").alias("nb"), "bb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ba"))
    lengths = F.col("na") * F.lit(1.0) >= F.col("nb") * F.lit(threshold)
    met = left.join(right, ["h", "c", "ba", "bb"]).where((F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & lengths)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("signatures").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("signatures").alias("sb"))
    return met.join(sa, "a").join(sb, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= threshold)
