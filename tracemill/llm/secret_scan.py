"""Secret scans (operator 10): base patterns plus assignment-aware lexing.

Three base patterns find key assignments, access keys and long hexadecimal runs.
Beside them each text is lexed as source or configuration syntax into
name-literal pairs (`name = "x"`, `name: x`, `"name": "x"`, `export NAME=x`,
`<name>x</name>`, command-line `--name x`, YAML blocks `name: |`, strings in
three quotes or back quotes over several lines, a quoted value in the line after
its name), constants are propagated (`a = "x"`, `secret = a`, `secret = a + "y"`),
and every literal is scored by how sensitive its target's name is and by how
random it looks; a literal of several lines is scored line by line. Literals that
reach the threshold become spans of the kind `lexed`; base spans always stay.
Comments are lexed like code: a secret in one is a secret.

Defined results: null text is empty and has no span; offsets are code points,
ends exclusive; equal rows have equal results; texts of any length are scanned
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import small_batches

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "lexed")
#: Base patterns: fixed values of the task.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are whole, so that short ones can be left out at once
_HINT = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

#: Parts of names and what they add to a literal's score.
NAME_PARTS = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "pass": 2.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.0,
    "private": 1.0, "signing": 1.0, "encryption": 1.0, "access": 1.0, "api": 1.0, "client": 0.5, "key": 1.5, "salt": 1.5, "cert": 0.5, "session": 0.5, "cookie": 1.0, "dsn": 1.5,
}
#: Score from which a literal is a secret.
THRESHOLD = 4.0
#: What a name scores at least for its literals to be secrets.
NAME_LEAST = 1.5
_BY_VALUE = sorted(NAME_PARTS.items(), key=lambda x: -x[1])
MIN_LITERAL = 8
#: Values that stand for a secret that is kept elsewhere: signs, variables, and phrases made of words only.
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\$\(.*\)|\$[A-Z_]+|%[A-Z_]+%|\{\{.*\}\}|(?:your|my|the|some|change|replace|insert|enter)(?:[-_ ]+[a-z]+)+"
    r"|(?:.*[^a-z])?(?:example|placeholder|redacted|changeme|dummy|sample)(?:[^a-z].*)?|none|null|true|false|undefined|todo|test)$"
)

_LEX = re.compile(
    r"""
    (?P<name>(?:(?<![\w.$-])["'](?P<qname>[A-Za-z_][\w.-]*)["']|(?<![\w.$-])--?(?P<flag>[A-Za-z][\w-]*)(?=[=\x20])|(?<![\w.$-])(?P<ident>[A-Za-z_$][\w.$-]*)))
    [\x20\t]*(?P<op>:=|=>|==?|:(?!//))?[\x20\t]*(?(op)(?:\\?\r?\n[\x20\t]*(?=["'`]))?)
    (?=["'`A-Za-z_$0-9+/|>])
    """,
    re.X | re.A,
)
_STRING = re.compile(r"\"\"\"((?s:.)*?)\"\"\"|'''((?s:.)*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`")
#: A block of YAML: its mark, then the lines that are indented more than the line of its name.
_BLOCK = re.compile(r"[|>][-+0-9]*[\x20\t]*\r?\n")
_LINE = re.compile(r"[^\r\n]+")
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#%^&*-]+")
_IDENT = re.compile(r"[A-Za-z_$][\w.$]*", re.A)
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)>(?P<value>[^<>\n]++)</(?P=name)>", re.A)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[_.\-$]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping within a kind."""
    out: list[tuple[int, int, str]] = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def entropy(s: str) -> float:
    """Bits a character."""
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    return -sum(n / len(s) * math.log2(n / len(s)) for n in counts.values()) if s else 0.0


def name_score(name: str) -> float:
    parts = [p.lower() for p in _CAMEL.split(name) if p]
    joined = "".join(parts)
    own = sum({p: NAME_PARTS.get(p, 0.0) for p in parts}.values())
    return max(own, *(v for k, v in NAME_PARTS.items() if len(k) >= 5 and k in joined)) if any(len(k) >= 5 and k in joined for k in NAME_PARTS) else own


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: length, kinds of characters, entropy."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return -10.0
    kinds = bool(re.search(r"[a-z]", value)) + bool(re.search(r"[A-Z]", value)) + bool(re.search(r"[0-9]", value)) + bool(re.search(r"[^A-Za-z0-9]", value))
    score = 0.5 * (kinds - 1) + min(1.0, len(value) / 32) + max(0.0, entropy(value) - 2.0) * 0.5
    return score - (1.5 if kinds == 1 and not value.isdigit() and not re.fullmatch(r"[0-9a-f]+", value) else 0.0)


class _Constant:
    """What a name stands for: a literal, or the constants that it is joined from."""

    __slots__ = ("literal", "parts", "score")

    def __init__(self, literal: tuple[int, int, str] | None, parts: list[_Constant] | None = None):
        self.literal, self.parts, self.score = literal, parts or [], -1.0

    def raised(self, score: float) -> Iterator[tuple[int, int, str]]:
        """The literals within that were never given for a name of this score. Scores are few, so each is met a few times only."""
        left = [self]
        while left:
            c = left.pop()
            if c.score < score:
                c.score = score
                if c.literal is not None:
                    yield c.literal
                left += c.parts


def _literal(text: str, start: int, end: int) -> _Constant:
    """A literal; one of several lines stands for its lines, without the space around them."""
    if "\n" not in (value := text[start:end]):
        return _Constant((start, end, value))
    lines = ((start + m.start() + len(m[0]) - len(m[0].lstrip()), m[0].strip()) for m in _LINE.finditer(value))
    return _Constant(None, [_Constant((at, at + len(line), line)) for at, line in lines if line])


def _block_end(text: str, name_at: int, at: int) -> int:
    """The end of the block that begins at a line's start: its lines are blank or indented more than the name's line."""
    begin = text.rfind("\n", 0, name_at) + 1
    indent = len(text[begin:name_at]) - len(text[begin:name_at].lstrip("\x20\t"))
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end + 1
        line = text[at:end]
        if line.strip() and len(line) - len(line.lstrip("\x20\t")) <= indent:
            break
        at = end
    return at


def lex_pairs(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(name, start, end, value) of every literal that is assigned to a name, constants propagated.

    A literal that reaches a name through a constant is given at the place where it is written,
    and is not given again for a name that scores no higher than one it was given for.
    """
    known: dict[str, _Constant] = {}
    at = 0
    while (m := _LEX.search(text, at)) is not None:
        name = m["qname"] or m["flag"] or m["ident"]
        if m["op"] is None and not m["flag"]:
            at = m.end("name")
            continue
        if m["op"] == "==":
            at = m.end()
            continue
        pos, parts, literal = m.end(), [], False
        while True:  # operands joined by +
            if (s := _STRING.match(text, pos)) is not None:
                i = s.lastindex or 1
                parts.append(_literal(text, s.start(i), s.end(i)))
                literal, pos = True, s.end()
            elif not parts and m["op"] == ":" and (block := _BLOCK.match(text, pos)) is not None:
                pos = _block_end(text, m.start(), block.end())
                parts.append(_literal(text, block.end(), pos))
                break
            elif not literal and not parts and (b := _BARE.match(text, pos)) is not None:
                word = _IDENT.match(text, pos)
                if word is not None and word[0] in known and (word.end() == b.end() or text[word.end() : word.end() + 1] in "+;,)"):
                    parts.append(known[word[0]])
                    pos = word.end()
                else:
                    parts.append(_Constant((b.start(), b.end(), b[0])))
                    pos = b.end()
                    break
            elif (word := _IDENT.match(text, pos)) is not None and word[0] in known:
                parts.append(known[word[0]])
                pos = word.end()
            else:
                break
            plus = _PLUS.match(text, pos)
            if plus is None:
                break
            pos = plus.end()
        if parts:
            known[name] = parts[0] if len(parts) == 1 else _Constant(None, parts)
            for start, end, value in known[name].raised(name_score(name)):
                yield name, start, end, value
        at = max(pos if parts else m.end("name"), m.end("name"), at + 1)
    for m in _ELEMENT.finditer(text):
        yield m["name"], m.start("value"), m.end("value"), m["value"]


def may_name(text: str) -> bool:
    """Whether a name in the text can reach NAME_LEAST: whether the name parts that stand anywhere in it add up to that, separators left out."""
    low = text.lower()
    for c in "_.-$":
        low = low.replace(c, "")
    left = NAME_LEAST
    for part, value in _BY_VALUE:
        if part in low:
            left -= value
            if left <= 0:
                return True
    return False


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    if not may_name(text):
        return []
    found = set()
    for name, start, end, value in lex_pairs(text):
        n = name_score(name)
        if n >= NAME_LEAST and n + literal_score(value) >= threshold:
            found.add((start, end, "lexed"))
    return sorted(found)


def all_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans; base spans and those that lexing adds (none that lies within a base span)."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [x for x in lexed_spans(text) if not any(a <= x[0] and x[1] <= b for a, b, _ in base)]
    return base, sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap are replaced together."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                base, every = all_spans(text)
                n = {k: sum(x[2] == k for x in base) for k in KINDS}
                rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            yield out.assign(doc_id=pdf["doc_id"].array)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every secret in their text replaced by a mark; all columns stay, null texts too."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, spans) if isinstance(t, str) and (spans := all_spans(t)[1]) else t)

    return docs.withColumn(text_col, clean(F.col(text_col)))
