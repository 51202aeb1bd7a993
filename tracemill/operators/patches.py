"""Changed lines of an edit, texts of a tool's result, kept inputs, hashed paths (rows 31-33, 280, 369): Column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Changed lines that a patch keeps, and characters of a tool's text (fixed values).
MAX_LINES = 2000
MAX_TEXT = 8192
#: What counts as a path within a text (fixed value).
PATH_TOKEN = r"(?<![\w.:~/\\-])(?:~|[A-Za-z]:)?(?:[/\\][\w.@#+%$=-]+)+[/\\]?"


def _patch(added: Column, removed: Column, hunks: Column) -> Column:
    """Added lines come first where there is no room for all."""
    room = F.greatest(F.lit(MAX_LINES) - F.size(added), F.lit(0))
    return F.struct(F.slice(added, 1, MAX_LINES).alias("added"), F.slice(removed, F.lit(1), room).alias("removed"), hunks.alias("hunks"), (F.size(added) + F.size(removed) > MAX_LINES).alias("truncated"))


def structured_patch(hunks_json: Column) -> Column:
    """Added and removed lines of a JSON array of hunks with prefixed lines; null if no hunk has lines (31)."""
    hunks = F.filter(F.from_json(hunks_json, "array<struct<lines:array<string>>>"), lambda h: h["lines"].isNotNull())
    lines = F.flatten(F.transform(hunks, lambda h: h["lines"]))
    of = lambda sign: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(sign))), lambda x: F.substring(x, 2, 2**31 - 1))
    return F.when(F.size(hunks) > 0, _patch(of("+"), of("-"), F.size(hunks)))


def _common(a: Column, b: Column) -> Column:
    """Number of equal leading elements. The shorter array is padded with nulls, which differ from every line."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def line_diff(old: Column, new: Column) -> Column:
    """The lines between what two texts have in common at both ends; null for equal texts (32)."""
    o, n = F.split(old, "\n", -1), F.split(new, "\n", -1)
    skip = _common(o, n)
    rest = lambda a: F.slice(a, skip + 1, F.size(a) - skip)
    tail = _common(F.reverse(rest(o)), F.reverse(rest(n)))
    middle = lambda a: F.slice(rest(a), F.lit(1), F.size(a) - skip - tail)
    return F.when(old != new, _patch(middle(n), middle(o), F.lit(1)))


def result_text(result_json: Column, fallback: Column) -> Column:
    """A tool's result as text: a JSON string, the text blocks of a JSON array, else the fallback; at most MAX_TEXT characters (33)."""
    start = F.substring(F.ltrim(result_json), 1, 1)
    blocks = F.filter(F.from_json(result_json, "array<struct<type:string,text:string>>"), lambda b: (b["type"] == "text") & b["text"].isNotNull())
    string = F.get(F.from_json(F.concat(F.lit("["), result_json, F.lit("]")), "array<string>"), 0)
    text = F.coalesce(F.when(start == '"', string).when(start == "[", F.array_join(F.transform(blocks, lambda b: b["text"]), "\n")), fallback)
    return F.struct(F.substring(text, 1, MAX_TEXT).alias("text"), (F.char_length(text) > MAX_TEXT).alias("truncated"))


def pick_input(input_json: Column, keys: Sequence[str]) -> Column:
    """The named members of a call's input, nested ones as JSON (369)."""
    return F.map_filter(F.from_json(input_json, "map<string,string>"), lambda k, v: k.isin(*keys))


def hash_paths(text: Column, salt: str, cwd: Column) -> Column:
    """Paths within a text made relative to the folder, or hashed with a salt where they lie elsewhere; file names stay (280)."""
    here = F.regexp_replace(F.replace(F.trim(cwd), F.lit("\\"), F.lit("/")), r"(?<=.)/$", "")

    def hidden(token: Column) -> Column:
        slashed = F.replace(token, F.lit("\\"), F.lit("/"))
        path = F.regexp_replace(slashed, r"(?<=.)/$", "")
        digest = F.substring(F.sha2(F.concat(F.lit(salt + "\0"), path), 256), 1, 8)
        away = F.concat(F.lit("p:"), digest, F.lit("/"), F.element_at(F.split(path, "/"), -1))
        near = F.startswith(path, F.concat(here, F.lit("/")))
        return F.when(F.coalesce(here, F.lit("")).isin("", "/"), away).when(path == here, F.lit(".")).when(near, F.substring(slashed, F.char_length(here) + 2, F.char_length(slashed))).otherwise(away)

    between, tokens = F.split(text, PATH_TOKEN, -1), F.regexp_extract_all(text, F.lit(PATH_TOKEN), F.lit(0))
    return F.array_join(F.zip_with(between, tokens, lambda b, t: F.concat(b, F.coalesce(hidden(t), F.lit("")))), "")
