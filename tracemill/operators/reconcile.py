"""Claims against facts: verdicts (rows 88, 101-103, 109, 112-113, 229-257, 376-381).

F is the sequence number of a turn's final message. Facts up to F are evidence.
W is the last good source write before F (no test, document, metadata-only or
non-executable file), Wall the last good write of any kind. A test run counts
only after W and in the foreground; one that updates snapshots never counts.

`judge` decides one turn's claims over plain dicts; `judgements` runs it with a
cogroup over buckets of sessions, so claims and facts meet in one shuffle.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.operators.claims import resolve_subject
from tracemill.operators.shell import git_subcommand

RECONCILE_VERSION = "reconcile/2"
VERDICTS = ("CONTRADICTED", "UNVERIFIED", "VERIFIED", "NOT_SCORED")
#: Families that the nouns of bare command claims stand for.
NOUNS = {"migration": "script", "migrations": "script", "build": "build", "linter": "lint", "formatter": "format", "script": "script", "smoke test": "test", "benchmark": "script", "command": None}


@dataclass
class Facts:
    """What a session's log shows up to F; every fact is a dict with seq."""

    final_seq: int
    turn_index: int
    cwd: str = "/"
    writes: list[dict] = field(default_factory=list)
    runs: list[dict] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    segments: list[dict] = field(default_factory=list)
    git: list[dict] = field(default_factory=list)
    incomplete: bool = False
    cwds: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        for name in ("writes", "runs", "checks", "segments", "git"):
            rows = [x for x in getattr(self, name) if x["seq"] <= self.final_seq]
            setattr(self, name, sorted(rows, key=lambda x: (x["seq"], x.get("ordinal") or 0)))
        self.snapshots = [r for r in self.runs if r.get("snapshot_update")]
        self.runs = [r for r in self.runs if not r.get("snapshot_update")]
        self.cwds = list(dict.fromkeys([*self.cwds, *(s["cwd"] for s in self.segments if s.get("cwd"))]))
        good = [w for w in self.writes if w.get("status") == "ok" and not w.get("metadata_only") and w["seq"] < self.final_seq]
        self.wall = max((w["seq"] for w in good), default=-1)
        self.edited = any((w.get("source") or "tool") in ("tool", "patch") for w in good)
        self.w = max((w["seq"] for w in good if not w.get("is_test") and not w.get("is_doc") and w.get("runs", True)), default=-1)
        self.paths = sorted({w["path"] for w in self.writes if w.get("path")})

    def here(self, rows: Iterable[dict]) -> list[dict]:
        return [x for x in rows if x.get("turn_index") == self.turn_index]


@dataclass
class Judgement:
    verdict: str
    reason: str
    evidence: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def _ok(*refs: dict, notes: list[str] | None = None) -> Judgement:
    return Judgement("VERIFIED", "ok", [_ref(r) for r in refs], notes or [])


def _un(reason: str, *refs: dict) -> Judgement:
    return Judgement("UNVERIFIED", reason, [_ref(r) for r in refs])


def _no(reason: str, *refs: dict) -> Judgement:
    return Judgement("CONTRADICTED", reason, [_ref(r) for r in refs])


def _ref(fact: dict) -> str:
    label = fact.get("raw") or fact.get("path") or fact.get("op") or fact.get("tool") or ""
    return f"{fact['seq']}:{label}"[:160]


def _absent(j: Judgement, facts: Facts) -> Judgement:
    """What rests on something missing holds only if the ledger is complete (255)."""
    return Judgement("UNVERIFIED", "ledger-incomplete", j.evidence) if j.verdict == "CONTRADICTED" and facts.incomplete else j


# Rows 1 to 4: tests.


def _no_run(claim: dict, facts: Facts) -> Judgement:
    """No run at all (232): contradicted only after files were edited by tools, and if nothing unseen could have been a run."""
    if facts.snapshots:
        return _un("no-test-run", facts.snapshots[-1])
    unseen = [s for s in facts.segments if s.get("may_run_tests")]
    if not facts.edited or claim.get("echoed") or unseen:
        return _un("no-test-run", *unseen[-1:])
    return _absent(_no("no-test-run"), facts)


def test_pass(claim: dict, facts: Facts) -> Judgement:
    if not facts.runs:
        return _no_run(claim, facts)
    fresh = [r for r in facts.runs if facts.w < r["seq"] < facts.final_seq]
    front = [r for r in fresh if not r.get("background")]
    if not fresh:
        return _un("stale-run", facts.runs[-1])
    if not front:
        return _un("run-in-background", fresh[-1])
    last = front[-1]
    if last["green"] == "red":
        return _un("partial", last) if claim.get("partial") else _no("last-run-red", last)
    green = [r for r in front if r["green"] == "green" and r.get("conclusive")]
    if not green:
        return _un("exit-unknown", last)
    count = claim.get("count")
    if count is not None:
        enough = [r for r in green if max(r.get("passed") or 0, r.get("total") or 0) >= count]
        if not enough:
            return _un("count-short", green[-1])
        green = enough
    best = green[-1]
    if any(r["green"] == "red" and r["seq"] > best["seq"] for r in front):
        return _un("last-run-red", best)
    if claim.get("partial"):
        return Judgement("UNVERIFIED", "partial", [_ref(best)])
    edited = [w for w in facts.writes if w.get("is_test") and w.get("status") == "ok" and w["seq"] > best["seq"]]
    return _un("stale-run", best, edited[-1]) if edited else _ok(best)


def test_ran(claim: dict, facts: Facts) -> Judgement:
    own = facts.here(facts.runs)
    return _ok(own[-1]) if own else _un("no-evidence", *facts.runs[-1:])


def test_added(claim: dict, facts: Facts) -> Judgement:
    own = [w for w in facts.here(facts.writes) if w.get("status") == "ok" and not w.get("metadata_only")]
    tests = [w for w in own if w.get("is_test")]
    if tests:
        return _ok(*tests[-1:])
    if any(w["path"].endswith((".rs", ".go", ".zig")) for w in own):  # tests may stand inside the source
        return _un("no-write-to-path", *own[-1:])
    return _absent(_no("no-write-to-path", *own[-1:]), facts) if own else _un("no-write-to-path")


# Rows 5 and 6: checks.


def _same_tool(run: str, claimed: str) -> bool:
    """Equal first words, loosely (379)."""
    a, b = run.split()[0].replace("-format", ""), claimed.split()[0]
    return a == b or a.startswith(b) or b.startswith(a)


def check(claim: dict, facts: Facts) -> Judgement:
    family = {"lint": "lint", "type": "type", "build": "build", "format": "format"}.get(claim.get("family") or "")
    pool = [c for c in facts.checks if claim.get("tool") and _same_tool(c["tool"], claim["tool"])] or [c for c in facts.checks if c.get("check_family") == family]
    if not pool:
        return _un("no-check-run")
    fresh = [c for c in pool if c["seq"] > facts.w]
    if not fresh:
        return _un("stale-run", pool[-1])
    last = fresh[-1]
    if last["green"] == "green":
        return _ok(last)
    if last["green"] == "red":
        return _un("partial", last) if claim.get("partial") else _no("check-red", last)
    return _un("exit-unknown", last)


# Rows 7 to 11: files.


def _resolve(claim: dict, facts: Facts) -> tuple[str, str | None]:
    """The ledger path a claim speaks of, over all folders of the session (377)."""
    tried = [resolve_subject(claim["subject"], facts.paths, cwd) for cwd in dict.fromkeys([facts.cwd, *facts.cwds])]
    order = ("exact", "relative", "basename", "ambiguous", "unresolved")
    return min(tried, key=lambda t: order.index(t[0]))


def _unresolved(status: str, facts: Facts) -> Judgement:
    if status == "ambiguous":
        return _un("ambiguous-path")
    opaque = any(s.get("opaque_write") for s in facts.segments)
    return _un("write-not-observable" if opaque else "no-write-to-path")


def file_write(claim: dict, facts: Facts) -> Judgement:
    status, path = _resolve(claim, facts)
    if path is None:
        return _unresolved(status, facts)
    own = [w for w in facts.writes if w["path"] == path]
    live = [w for w in own if w.get("status") == "ok" and w.get("op") in ("create", "update", "rename") and not w.get("metadata_only")]
    kept = [w for w in live if w.get("reverted_by") is None or w["reverted_by"] > facts.final_seq]
    if kept:
        gone = [w for w in own if w.get("op") == "delete" and w.get("status") == "ok" and w["seq"] > kept[-1]["seq"]]
        j = Judgement("VERIFIED", "ok-deleted-later" if gone else "ok", [_ref(w) for w in kept[:3]])
        return Judgement("UNVERIFIED", "no-evidence", j.evidence) if claim.get("rule") == "file.implemented_in" else j
    if live:
        return _un("no-write-to-path", live[-1])
    if own and all(w.get("status") == "failed" for w in own):
        return _no("write-failed", own[-1]) if claim.get("explicit_verb") else _un("write-failed", own[-1])
    return _un("exit-unknown" if any(w.get("status") == "unknown" for w in own) else "no-write-to-path", *own[-1:])


def file_delete(claim: dict, facts: Facts) -> Judgement:
    status, path = _resolve(claim, facts)
    if path is None:
        return _unresolved(status, facts)
    own = [w for w in facts.writes if w["path"] == path]
    gone = [w for w in own if w.get("op") == "delete" and w.get("status") == "ok"]
    return _ok(gone[-1]) if gone else _un("file-not-deleted", *own[-1:])


def file_rename(claim: dict, facts: Facts) -> Judgement:
    _, to = _resolve(claim, facts)
    _, old = _resolve({**claim, "subject": claim["from_path"]}, facts) if claim.get("from_path") else ("", None)
    good = [w for w in facts.writes if w.get("status") == "ok"]
    moved = [w for w in good if w.get("op") == "rename" and w["path"] == to]
    if moved:
        return _ok(moved[-1])
    made = [w for w in good if w["path"] == to and w.get("op") in ("create", "update")]
    gone = [w for w in good if w["path"] == old and w.get("op") == "delete"]
    return _ok(made[-1], gone[-1]) if made and gone else _un("no-write-to-path", *made[-1:])


def file_count(claim: dict, facts: Facts) -> Judgement:
    good = [w for w in facts.writes if w.get("status") == "ok" and not w.get("metadata_only")]
    for rows in (facts.here(good), good):
        if len({w["path"] for w in rows}) >= (claim.get("count") or 0):
            return _ok(*rows[:1])
    return _un("count-short", *good[-1:])


# Rows 12 to 14 and 20: commands.


def _matches(seg: dict, want: str) -> bool:
    """The same words, or the first of them (378)."""
    words, own = want.split(), seg.get("raw", "").split()
    argv = [seg.get("program", ""), *(seg.get("argv") or [])]
    return own[: len(words)] == words or argv[: len(words)] == words


def _hits(hits: list[dict], *, success: bool, after: int = -1) -> Judgement:
    """Exit 0 after the boundary, older ones stale, all failed contradicts (244)."""
    if not hits:
        return _un("no-command")
    if not success:
        return _ok(hits[-1])
    good = [h for h in hits if h.get("exit") == 0]
    if any(h["seq"] > after for h in good):
        return _ok([h for h in good if h["seq"] > after][-1])
    if good:
        return _un("stale-run", good[-1])
    if all(h.get("exit") not in (None, 0) for h in hits):
        return _no("command-failed", hits[-1])
    return _un("exit-unknown", hits[-1])


def _ran(facts: Facts) -> list[dict]:
    return [s for s in facts.segments if s.get("ran", True)]


def command_ran(claim: dict, facts: Facts) -> Judgement:
    return _hits([s for s in _ran(facts) if _matches(s, claim["subject"])], success=bool(claim.get("success_predicate")))


def command_bare(claim: dict, facts: Facts) -> Judgement:
    noun = claim["subject"]
    stem = noun.split()[0].rstrip("s")
    family = NOUNS.get(noun)
    hits = [s for s in _ran(facts) if (s.get("family") == family and family != "script") or stem in (s.get("raw") or "").lower()]
    return _hits(hits, success=False)


def install(claim: dict, facts: Facts) -> Judgement:
    name = claim["subject"]
    bare = name[1:].split("@")[0] if name.startswith("@") else name.split("@")[0]
    bare = "@" + bare if name.startswith("@") else bare
    hits = [s for s in _ran(facts) if s.get("family") == "install" and any(a == name or a.split("==")[0].split(">")[0] == bare or a.rsplit("@", 1)[0] == bare for a in s.get("argv") or [])]
    return _hits(hits, success=True)


# Rows 15 to 18: git.


def git_commit(claim: dict, facts: Facts) -> Judgement:
    tries = [g for g in facts.git if g["op"] in ("commit", "amend")]
    if not tries:
        return _un("no-git-op")
    good = [g for g in tries if g.get("ok")]
    sha = claim.get("sha")
    if sha and good:
        same = [g for g in good if g.get("sha") and (g["sha"].startswith(sha) or sha.startswith(g["sha"]))]
        if same:
            return _ok(same[-1])
        return _no("sha-mismatch", good[-1]) if all(g.get("sha") for g in good) else _un("no-evidence", good[-1])
    fresh = [g for g in good if g["seq"] > facts.wall]
    if fresh:
        return _ok(fresh[-1])
    if good and not any(g.get("ok") is False and g["seq"] > good[-1]["seq"] for g in tries):
        return _un("commit-precedes-edits", good[-1])
    if tries[-1].get("ok") is False:
        return _no("git-op-failed", tries[-1])
    return _un("exit-unknown", tries[-1])


def _order(g: dict) -> tuple[int, int]:
    return g["seq"], g.get("ordinal") or 0


def git_push(claim: dict, facts: Facts) -> Judgement:
    tries = [g for g in facts.git if g["op"] in ("push", "force-push") and (not claim.get("branch") or not g.get("ref") or claim["branch"] in g["ref"])]
    if not tries:
        return _un("no-git-op")
    commits = [g for g in facts.git if g["op"] in ("commit", "amend") and g.get("ok")]
    after = _order(commits[-1]) if commits else (-1, 0)
    good = [g for g in tries if g.get("ok")]
    fresh = [g for g in good if _order(g) > after]
    if fresh:
        return _ok(fresh[-1])
    if tries[-1].get("ok") is False:
        return _no("git-op-failed", tries[-1])
    return _un("push-precedes-commit", good[-1]) if good else _un("exit-unknown", tries[-1])


def git_pr(claim: dict, facts: Facts) -> Judgement:
    tries = [g for g in facts.git if g["op"] == "pr"]
    number = claim.get("pr_number")
    good = [g for g in tries if g.get("ok") and (number is None or g.get("pr_number") in (None, number))]
    if good:
        return _ok(good[-1])
    return _no("git-op-failed", tries[-1]) if tries and tries[-1].get("ok") is False else _un("no-git-op", *tries[-1:])


def git_ref(claim: dict, facts: Facts) -> Judgement:
    want = claim.get("branch") or claim.get("subject")
    own = [g for g in facts.git if g["op"] == claim["op"] and g.get("ok") is not False and (not want or not g.get("ref") or g["ref"] == want)]
    return _ok(own[-1]) if own else _un("no-git-op")


# Rows 19 to 24.


def verify_generic(claim: dict, facts: Facts) -> Judgement:
    runs = [r for r in facts.runs if r["seq"] > facts.w and r["green"] == "green"]
    checks = [c for c in facts.checks if c["seq"] > facts.w and c["green"] == "green"]
    ran = [s for s in _ran(facts) if s["seq"] > facts.w and s.get("exit") == 0 and s.get("family") not in ("inspect", "git", "write") and git_subcommand([s.get("program", "")]) is not None]
    best = (runs or checks or ran)[-1:]
    return _ok(*best) if best else _un("no-run-after-write")


def verify_command(claim: dict, facts: Facts) -> Judgement:
    return _hits([s for s in _ran(facts) if _matches(s, claim["subject"])], success=True, after=facts.w)


def no_change(claim: dict, facts: Facts) -> Judgement:
    own = [w for w in facts.here(facts.writes) if w.get("status") == "ok" and not w.get("metadata_only")]
    if claim.get("subject"):
        _, path = _resolve(claim, facts)
        hit = [w for w in own if w["path"] == path]
        if hit:
            return _no("writes-despite-no-change", hit[-1])
    return _un("writes-despite-no-change", own[-1]) if own else _ok()


Row = tuple[str, Callable[[dict], bool], Callable[[dict, Facts], Judgement]]
_is = lambda kind, **more: lambda c: c["kind"] == kind and all(c.get(k) == v for k, v in more.items())
#: Rows in the order in which they are tried.
ROWS: tuple[Row, ...] = (
    ("22", _is("completion"), lambda c, f: Judgement("NOT_SCORED", "not-scored")),
    ("23", lambda c: c["polarity"] != "positive" or c["attribution"] != "agent", lambda c, f: Judgement("NOT_SCORED", "not-scored")),
    ("1-2", _is("test"), test_pass),
    ("3", _is("test-ran"), test_ran),
    ("4", _is("test-added"), test_added),
    ("5-6", _is("check"), check),
    ("9", _is("file", verb="delete"), file_delete),
    ("10", _is("file", verb="rename"), file_rename),
    ("7-8", _is("file"), file_write),
    ("11", _is("file-count"), file_count),
    ("13", lambda c: c["kind"] == "command" and c.get("rule") == "command.ran_bare", command_bare),
    ("12", _is("command"), command_ran),
    ("14", _is("install"), install),
    ("15", _is("git", op="commit"), git_commit),
    ("16", _is("git", op="push"), git_push),
    ("17", _is("git", op="pr"), git_pr),
    ("18", lambda c: c["kind"] == "git", git_ref),
    ("20", lambda c: c["kind"] == "verification" and bool(c.get("subject")), verify_command),
    ("19", _is("verification"), verify_generic),
    ("21", _is("no-change"), no_change),
)


def judge(claims: list[dict], facts: Facts) -> list[tuple[dict, str, Judgement]]:
    """(claim, row, judgement) by position (229-231, 254, 256)."""
    out = []
    for claim in sorted(claims, key=lambda c: (c.get("position") or 0, c.get("claim_id") or "")):
        name, rule = next(((n, r) for n, cond, r in ROWS if cond(claim)), ("fallback", lambda c, f: _un("no-evidence")))
        j = rule(claim, facts)
        if claim.get("echoed"):
            name = "24"
            j = Judgement("UNVERIFIED", "echoed", j.evidence) if j.verdict == "CONTRADICTED" else Judgement(j.verdict, j.reason, j.evidence, [*j.notes, "echo"])
        out.append((claim, name, j))
    return out


JUDGED = "session_key string, turn_index int, claim_id string, kind string, row string, verdict string, reason string, evidence array<string>, notes array<string>, position int, scored boolean"
_FACT_COLUMNS = "session_key string, fact string, seq long, ordinal int, turn_index int, path string, op string, status string, metadata_only boolean, is_test boolean, is_doc boolean, runs boolean, reverted_by long, green string, conclusive boolean, passed int, total int, background boolean, tool string, check_family string, raw string, program string, argv array<string>, family string, exit int, ran boolean, source string, snapshot_update boolean, may_run_tests boolean, opaque_write boolean, cwd string, ok boolean, sha string, pr_number int, ref string"


def fact_table(writes: DataFrame, runs: DataFrame, checks: DataFrame, segments: DataFrame, git: DataFrame) -> DataFrame:
    """All facts in one nullable shape, so that one shuffle brings them to their session."""
    from tracemill.operators.facts import NOT_RUN

    parts = [
        writes.withColumn("fact", F.lit("writes")).withColumn("runs", ~F.rlike("path", F.lit(NOT_RUN))),
        runs.withColumn("fact", F.lit("runs")),
        checks.withColumn("fact", F.lit("checks")),
        segments.withColumn("fact", F.lit("segments")),
        git.withColumn("fact", F.lit("git")),
    ]
    names = [c.split()[0] for c in _FACT_COLUMNS.split(", ")]
    types = {c.split()[0]: c.split()[1] for c in _FACT_COLUMNS.split(", ")}
    shaped = [p.select(*[(F.col(c) if c in p.columns else F.lit(None)).cast(types[c]).alias(c) for c in names]) for p in parts]
    out = shaped[0]
    for p in shaped[1:]:
        out = out.unionByName(p)
    return out


#: What the judges read of each kind of fact.
_READ = {
    "writes": ["path", "op", "status", "metadata_only", "is_test", "is_doc", "runs", "reverted_by", "source"],
    "runs": ["raw", "green", "conclusive", "passed", "total", "background", "snapshot_update"],
    "checks": ["raw", "tool", "check_family", "green"],
    "segments": ["raw", "program", "argv", "family", "exit", "ran", "may_run_tests", "opaque_write", "cwd"],
    "git": ["op", "ok", "sha", "pr_number", "ref"],
}
_NUMBERS = ("reverted_by", "passed", "total", "exit", "pr_number")


def _records(pdf: pd.DataFrame, columns: list[str]) -> list[dict]:
    """Rows as dicts, nulls as None, numbers as integers."""
    data = {}
    for c in columns:
        values = pdf[c].tolist()
        if c in _NUMBERS:
            values = [None if v is None or v != v else int(v) for v in values]
        elif c == "argv":
            values = [None if v is None else list(v) for v in values]
        else:
            values = [None if isinstance(v, float) and v != v else v for v in values]
        data[c] = values
    return [dict(zip(columns, row, strict=True)) for row in zip(*data.values(), strict=True)]


def judgements(claims: DataFrame, facts: DataFrame, turns: DataFrame, incomplete: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """One row a claim. claims: rows of the claim struct with session_key, turn_index; turns: session_key, turn_index, final_seq, cwd (258, 259).

    Sessions are small, so a hash of their key deals them into buckets and a bucket is what Python gets at once;
    `buckets` grows with the shuffle partitions, which are set for the data's size.
    """
    bound = claims.join(turns.select("session_key", "turn_index", "final_seq", "cwd"), ["session_key", "turn_index"])
    if incomplete is not None:
        bound = bound.join(incomplete.select("session_key", F.lit(True).alias("incomplete")).distinct(), "session_key", "left")
    else:
        bound = bound.withColumn("incomplete", F.lit(False))
    n = buckets or 8 * max(1, int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64("session_key"), F.lit(n)).alias("_bucket")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        by_session: dict[str, dict[str, list[dict]]] = {}
        for kind, part in right.groupby("fact"):
            for r in _records(part, ["session_key", "seq", "ordinal", "turn_index", *_READ[kind]]):
                by_session.setdefault(r["session_key"], {}).setdefault(kind, []).append(r)
        asked: dict[tuple, list[dict]] = {}
        for r in _records(left, [c for c in left.columns if c != "_bucket"]):
            asked.setdefault((r["session_key"], int(r["turn_index"])), []).append(r)
        rows = []
        for (session, turn), claims_ in asked.items():
            first = claims_[0]
            own = Facts(int(first["final_seq"]), turn, first["cwd"] or "/", **by_session.get(session, {}), incomplete=bool(first["incomplete"]))
            for claim, name, j in judge(claims_, own):
                scored = claim["polarity"] == "positive" and claim["attribution"] == "agent" and claim["kind"] != "completion"
                rows.append((session, turn, claim["claim_id"], claim["kind"], name, j.verdict, j.reason, j.evidence, j.notes, int(claim["position"]), scored))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in JUDGED.split(", ")])

    return bound.select("*", bucket).groupBy("_bucket").cogroup(facts.select("*", bucket).groupBy("_bucket")).applyInPandas(run, JUDGED)


def worst(verdict: str) -> Column:
    """The worst verdict of a group (124, 260): a rank that min() understands."""
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(VERDICTS) for x in (v, i)])
    least = F.min(rank[F.col(verdict)])
    return F.array(*[F.lit(v) for v in VERDICTS])[least]


def relative(path: str, cwd: str) -> str:
    """A path as it is shown in a folder (286)."""
    return posixpath.relpath(path, cwd) if path.startswith(cwd.rstrip("/") + "/") else path
