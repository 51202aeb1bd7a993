"""BPE encoding and decoding (operator 2) with a pair occurrence index.

A worker reads its partition in batches of some BATCH_CHARS characters. All
distinct pre-tokens of a batch form one array of symbols. An index maps the rank
of each adjacent pair to all of the pair's positions; a heap holds the ranks
that are active. Ranks are applied in ascending order, each to all of its
positions at once, and the lists of the pairs left and right of a merge are
updated. A pre-token is merged once a batch, however often it stands there, and
nothing is kept from one batch to the next.

The vocabulary file is read on the driver, by its path; the workers get its
content (1 to 3 MB, fixed by the file) in a broadcast.

Defined results: null text is empty text, has no ids and decodes to ''; equal
rows have equal results; texts of any length are encoded whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import small_batches

#: The pre-tokenizer's pattern (fixed value of the byte-level vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of Latin-1 characters, with their letters, digits and white space spelled out.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PATTERN_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Where a long text may be cut: a space between something else and a letter always starts a pre-token.
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")
#: Characters whose pre-tokens are merged together, and those that are split at once.
BATCH_CHARS, SPLIT_CHARS = 3_000_000, 1_000_000
#: From so many positions on a rank is applied by array operations.
MANY = 32
_NONE = np.iinfo(np.int32).max
_GONE = -1


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers for the pre-tokens of a batch, in the order of their first occurrence."""

    def __missing__(self, key: str | int) -> int:
        n = self[key] = len(self)
        return n


class PairIndexBPE:
    """Encodes and decodes as the vocabulary file says."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        vocab: dict[str, int] = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.by_rank = {rank: (pair, new) for pair, (rank, new) in self.merges.items()}
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        id_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens with white-space rules are not supported")
        id_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.n_ids = max(id_bytes) + 1
        # What each id decodes to, one after another; the last, empty one stands for ids out of the vocabulary.
        by_id = [id_bytes.get(i, b"") for i in range(self.n_ids)] + [b""]
        self.out_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.out_len = np.array([len(x) for x in by_id], dtype=np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        # The end of a word is the symbol n_ids; its pairs and those of other bytes have no rank.
        self.byte_id = np.array([vocab[alphabet[b]] for b in range(256)], dtype=np.int32)
        self.byte_pairs = np.full((257, 257), _NONE, dtype=np.int32)
        byte_of = {int(i): b for b, i in enumerate(self.byte_id)}
        partners: tuple[dict, dict] = ({}, {})  # of each symbol: those that may stand right of it, left of it, and the pair's rank
        for (a, b), (rank, _) in self.merges.items():
            if a in byte_of and b in byte_of:
                self.byte_pairs[byte_of[a], byte_of[b]] = rank
            for own, key, other in ((partners[0], a, b), (partners[1], b, a)):
                own.setdefault(key, []).append((other, rank))
        self.right, self.left = ({k: tuple(np.array(x, dtype=np.int32) for x in zip(*v, strict=True)) for k, v in own.items()} for own in partners)
        self.ranks = np.full(self.n_ids + 1, _NONE, dtype=np.int32)  # by symbol, filled for one merge at a time
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern, self.latin = regex.compile(PATTERN), re.compile(PATTERN_LATIN)
        self.library = None

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            if max(text) < "\u0500":
                return self.pattern.findall(text)
        # Beyond these the two libraries know different versions of Unicode; the tokenizer's own splitter decides.
        if self.library is None:
            from tokenizers import pre_tokenizers

            self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def pretokens(self, text: str) -> Iterator[list[str | int]]:
        """Pre-tokens in order, long texts in several lists; special tokens of the vocabulary as their ids."""
        parts = [text] if self.split_special is None or not any(t in text for t in self.special) else self.split_special.split(text)
        for i, part in enumerate(parts):
            if i % 2:
                yield [self.special[part]]
                continue
            at = 0
            while len(part) - at > SPLIT_CHARS and (cut := _CUT.search(part, at + SPLIT_CHARS)) is not None:
                yield self._pieces(part[at : cut.start()])
                at = cut.start()
            if at < len(part):
                yield self._pieces(part[at:] if at else part)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts): the ids of all words one after another and where each begins, and the end.

        One pair occurrence index serves all words. Symbols lie in one array with a mark around words, so that no
        pair reaches over a word's end; next and prev lead over the symbols that merges took away.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(size + 1)  # the mark after each word, with one before the first
        total = int(ends[-1]) + 1 if len(raw) else 1
        byte = np.full(total, 256, dtype=np.int32)
        at = np.ones(total, dtype=bool)
        at[0], at[ends] = False, False
        byte[at] = np.frombuffer(b"".join(raw), dtype=np.uint8)
        mark = self.n_ids
        symbols = np.where(byte < 256, self.byte_id[np.minimum(byte, 255)], np.int32(mark)).astype(np.int32)
        nxt, prv = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        nxt[-1], prv[0] = total - 1, 0
        rank_at = np.full(total, _NONE, dtype=np.int32)  # rank of the pair that begins here
        rank_at[:-1] = self.byte_pairs[byte[:-1], byte[1:]]
        order = np.flatnonzero(rank_at != _NONE)
        order = order[np.argsort(rank_at[order], kind="stable")]
        own = rank_at[order]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
        index: dict[int, list[int]] = dict(zip(own[cuts].tolist(), (x.tolist() for x in np.split(order, cuts[1:])), strict=True)) if len(own) else {}
        active = list(index)
        heapq.heapify(active)
        symbol, after, before, rank_of = memoryview(symbols), memoryview(nxt), memoryview(prv), memoryview(rank_at)
        merges, by_rank, ranks = self.merges, self.by_rank, self.ranks
        nothing = (None, None)

        def add(position: int, rank: int) -> None:
            known = index.get(rank)
            if known is None:
                index[rank] = [position]
                heapq.heappush(active, rank)
            else:
                known.append(position)

        while active:
            rank = heapq.heappop(active)
            (left, right), new = by_rank[rank]
            places = index.pop(rank)
            if len(places) < MANY or left == right:
                for i in sorted(places):  # leftmost first: in "aaa" the first two merge
                    if rank_of[i] != rank:
                        continue  # an earlier merge took one of the two
                    j = after[i]
                    k = after[j]
                    symbol[i], symbol[j], rank_of[j] = new, _GONE, _NONE
                    after[i], before[k] = k, i
                    m = merges.get((new, symbol[k]))
                    if m is None:
                        rank_of[i] = _NONE
                    else:
                        rank_of[i] = m[0]
                        add(i, m[0])
                    h = before[i]
                    m = merges.get((symbol[h], new))
                    if m is None:
                        rank_of[h] = _NONE
                    else:
                        rank_of[h] = m[0]
                        add(h, m[0])
                continue
            i = np.array(places, dtype=np.int32)
            i = i[rank_at[i] == rank]
            j = nxt[i]
            k = nxt[j]
            symbols[i], symbols[j] = new, _GONE
            rank_at[j] = _NONE
            nxt[i], prv[k] = k, i
            rank_at[i] = -1  # marks those that merged: the pair of two such neighbours is the left one's
            h = prv[i]
            h = h[rank_at[h] != -1]
            for place, (others, known) in ((i, self.right.get(new, nothing)), (h, self.left.get(new, nothing))):
                if others is None:
                    rank_at[place] = _NONE
                    continue
                ranks[others] = known
                got = ranks[symbols[nxt[place] if place is i else place]]
                ranks[others] = _NONE
                rank_at[place] = got
                some = got != _NONE
                for p, r in zip(place[some].tolist(), got[some].tolist(), strict=True):
                    add(p, r)
        kept = (symbols != _GONE) & (symbols != mark)
        before_end = np.cumsum(kept)
        return symbols[kept].astype("<u4"), np.concatenate(([0], before_end[ends])) if len(raw) else np.zeros(1, dtype=np.int64)

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        numbers = _Numbers()
        split = [[np.fromiter(map(numbers.__getitem__, some), dtype=np.int32, count=len(some)) for some in self.pretokens(t)] if t else [] for t in texts]
        words = [p for p in numbers if isinstance(p, str)]
        ids, starts = self.merge_words(words)
        if len(words) < len(numbers):  # special tokens are ids of their own
            keys = list(numbers)
            special = np.array([isinstance(p, int) for p in keys])
            first, size = np.empty(len(keys), dtype=np.int64), np.ones(len(keys), dtype=np.int64)
            first[special] = len(ids) + np.arange(special.sum())
            first[~special], size[~special] = starts[:-1], np.diff(starts)
            ids = np.concatenate((ids, np.array([p for p in keys if isinstance(p, int)], dtype="<u4")))
        else:
            first, size = starts[:-1], np.diff(starts)
        del numbers, words
        for at, pieces in enumerate(split):
            split[at] = None
            yield np.concatenate([np.zeros(0, dtype="<u4"), *(_gather(ids, first[p], size[p]) for p in pieces)])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; ids out of the vocabulary stand for nothing."""
        ids = np.asarray(ids, dtype=np.int64)
        ids = np.where((ids < 0) | (ids > self.n_ids), self.n_ids, ids)
        return _gather(self.out_bytes, self.out_start[ids], self.out_len[ids]).tobytes().decode("utf-8", errors="replace")


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at `first` and have `size` members, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(first - (ends - size), size) + np.arange(total)]


_made: dict[str, PairIndexBPE] = {}


def _tokenizer(content: str) -> PairIndexBPE:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = PairIndexBPE(content)
    return _made[key]


def _encoded(own: PairIndexBPE, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with their texts' ids, some million characters at a time; BATCH_CHARS characters share a pair index."""
    held: list[pd.DataFrame] = []
    chars = 0

    def flush() -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        ends = rows["text"].map(lambda t: len(t) if isinstance(t, str) else 0).cumsum().to_numpy()
        found, at = own.encode_batch(rows["text"]), 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT_CHARS, side="right")))
            yield rows.iloc[at:to], [next(found) for _ in range(to - at)]
            at = to

    for pdf in batches:
        if len(pdf):
            held.append(pdf.assign(doc_id=pdf["doc_id"].astype("Int64")))
            chars += sum(len(t) for t in pdf["text"] if isinstance(t, str))
        if chars >= BATCH_CHARS:
            yield from flush()
            held, chars = [], 0
    if held:
        yield from flush()


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, ids (array of int) of every text; with_text adds the text."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _tokenizer(content.value)
        for part, ids in _encoded(own, batches):
            out = pd.DataFrame({"doc_id": part["doc_id"].array, "ids": [x.astype(np.int32) for x in ids]})
            yield out.assign(text=part["text"].array) if with_text else out

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, ids array<int>" + (", text string" if with_text else ""))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of every row of doc_id, ids."""
    small_batches(encoded.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _tokenizer(content.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [own.decode([] if x is None else x) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes in one pass, so that no ids are moved."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _tokenizer(content.value)
        for part, ids in _encoded(own, batches):
            ids_sha = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            text_sha = [hashlib.sha256(own.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            yield pd.DataFrame({"doc_id": part["doc_id"].array, "n_tokens": np.array([len(x) for x in ids], dtype=np.int64), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
