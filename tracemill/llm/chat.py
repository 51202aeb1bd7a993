"""Chat formatting (operator 3): budgeted windows over conversations.

Rows are shuffled by conversation and sorted by turn; each conversation is then
streamed. Prefix sums of the turns' tokens choose spans of whole turns that fit
the budget. Every window repeats the conversation's system turn and as much of
the turns before its span as the history budget allows; only assistant turns of
the span itself are under the loss mask, so repeated targets are masked and
every target is trained on once. A turn that exceeds the budget by itself gets
a window of its own, whole.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Control strings
inside roles and texts are escaped reversibly: every `<`, n backslashes, `|`
gets one backslash more.

Defined results: null texts and roles are empty; rows that share a turn number
are ordered by role, then text, and all kept; a null conversation id is a
conversation of its own; empty texts are turns without tokens; an empty table
gives no rows; other columns are ignored. Memory is bounded by the budget and
the longest turn, not by the conversation: a conversation that holds a third of
all rows is streamed by one task, which only SHA-256 over it makes necessary.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import shuffle_parts, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens a window may hold, and how many of them may be repeated history.
BUDGET, HISTORY = 1024, 256
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
_TOKEN = re.compile(r"\w+|[^\w\s]")
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_ROW = "conv_id long, window int, n_system int, n_repeated int, text string, loss_start array<int>, loss_end array<int>, n_tokens int"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    """A role stands in one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(text: str) -> int:
    """Words and single signs: a bound that needs no vocabulary."""
    return sum(1 for _ in _TOKEN.finditer(text))


class Windows:
    """Takes one conversation's turns in order and gives its windows as they fill."""

    def __init__(self, conv_id, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, int] | None = None
        self.past: deque[tuple[str, int]] = deque()  # turns before the span that fit the history budget
        self.span: list[tuple[str, int, int, int]] = []  # formatted, tokens, start and end of its target (-1: none)
        self.prefix = [0]  # prefix sums of the span's tokens
        self.number, self.first = 0, True
        self.opening: tuple[str, int] | None = None  # the system turn, while the first window is still filling

    def _repeated(self) -> int:
        return (self.system[1] if self.system else 0) + sum(t for _, t in self.past)

    def add(self, role: str, text: str) -> Iterator[tuple]:
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        formatted, tokens = f"{head}{body}{END}\n", count_tokens(text) + TURN_TOKENS
        if self.span and self._repeated() + self.prefix[-1] + tokens > self.budget:
            yield self.window()
        # The history gives way to a turn that would not fit beside it.
        while not self.span and self.past and self._repeated() + tokens > self.budget:
            self.past.popleft()
        target = (len(head), len(head) + len(body)) if role == "assistant" else (-1, -1)
        self.span.append((formatted, tokens, *target))
        self.prefix.append(self.prefix[-1] + tokens)
        if self.first and role == "system":
            self.opening = (formatted, tokens)
        self.first = False

    def window(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for formatted, _ in [*([self.system] if self.system else []), *self.past]:
            parts.append(formatted)
            at += len(formatted)
        for formatted, _, a, b in self.span:
            if a >= 0:
                starts.append(at + a)
                ends.append(at + b)
            parts.append(formatted)
            at += len(formatted)
        out = (self.conv_id, self.number, int(self.system is not None), len(self.past), "".join(parts), starts, ends, self._repeated() + self.prefix[-1])
        turns = [(f, t) for f, t, _, _ in self.span]
        if self.opening is not None:  # from here on it is repeated as the system turn, not as history
            self.system, self.opening, turns = self.opening, None, turns[1:]
        self.past.extend(turns)
        # A suffix of the past whose prefix sums fit: whole turns only.
        room, total = self.history, sum(t for _, t in self.past)
        while self.past and total > room:
            total -= self.past.popleft()[1]
        self.span, self.prefix = [], [0]
        self.number += 1
        return out

    def close(self) -> Iterator[tuple]:
        if self.span:
            yield self.window()


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "window", "n_system", "n_repeated", "text", "loss_start", "loss_end", "n_tokens"])
    return out.assign(conv_id=out["conv_id"].astype("Int64"))


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, n_system, n_repeated (turns before the span), text, the loss mask's spans, n_tokens. Windows of a conversation follow one another in one partition."""
    if budget < 1 or history < 0:
        raise ValueError("the budget must be positive and the history not negative")
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    laid = rows.repartition(max(1, shuffle_parts(rows.sparkSession)), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Windows | None = None
        held: list[tuple] = []
        chars = 0
        for pdf in batches:
            ids = pdf["conv_id"].astype("Int64")
            for conv_id, null, role, text in zip(ids.fillna(0), ids.isna(), pdf["role"], pdf["text"], strict=True):
                key = None if null else int(conv_id)
                if now is None or now.conv_id != key:
                    if now is not None:
                        held += now.close()
                    now = Windows(key, budget, history)
                held += now.add(role, text)
                chars += len(text)
                if chars > 8_000_000:
                    yield _rows(held)
                    held, chars = [], 0
        if now is not None:
            held += now.close()
        yield _rows(held)

    return laid.mapInPandas(run, _ROW)


def parse_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    out, at = [], 0
    while at < len(text):
        head = text.index("\n", at)
        end = text.index(END, head)
        # Escaping leaves no control string inside a text, but a text may end in "<".
        out.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end])))
        at = end + len(END) + 1
    return out


def read_back(windows: DataFrame, laid: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the windows.

    laid: the windows come straight from format_conversations, a conversation's in order in one partition; others
    (read from files, filtered, joined) are shuffled by conversation and sorted first.
    """
    if not laid:
        windows = windows.repartition(max(1, shuffle_parts(windows.sparkSession)), "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []

        def row() -> tuple:
            return (now["id"], now["n"], now["turns"].hexdigest(), now["loss"], now["loss_sha"].hexdigest(), now["chars"])

        for pdf in batches:
            ids = pdf["conv_id"].astype("Int64")
            for i, (conv_id, null) in enumerate(zip(ids.fillna(0), ids.isna(), strict=True)):
                key = None if null else int(conv_id)
                if now is None or now["id"] != key:
                    if now is not None:
                        rows.append(row())
                    now = {"id": key, "n": 0, "turns": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0}
                text = pdf["text"].iat[i]
                turns = parse_window(text)[int(pdf["n_system"].iat[i]) + int(pdf["n_repeated"].iat[i]) :]
                for role, said in turns:
                    now["turns"].update(f"{role}\n{said}\n".encode())
                now["n"] += len(turns)
                for a, b in zip(pdf["loss_start"].iat[i], pdf["loss_end"].iat[i], strict=True):
                    target = unescape(text[a:b])
                    now["loss"] += len(target)
                    now["loss_sha"].update(target.encode())
                now["chars"] += len(text)
        if now is not None:
            rows.append(row())
        out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        yield out.assign(conv_id=out["conv_id"].astype("Int64"), n_turns=out["n_turns"].astype(np.int64), loss_chars=out["loss_chars"].astype(np.int64), formatted_chars=out["formatted_chars"].astype(np.int64))

    return windows.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
