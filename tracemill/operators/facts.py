"""Typed facts from tool calls (rows 166, 171-213, 287, 382-399).

`calls` has the columns of hook_ledger.tool_calls. `commands` adds the segments
of shell calls; every other extractor is relational over calls and segments, so
Spark plans them as projections of one exploded scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import host_of, is_private_host
from tracemill.operators import runners, shell

KEYS = ["session_key", "turn_index", "seq", "tool_call_id"]

#: Paths by what they are (fixed values).
TEST_FILE = r"(?i)(?:^|/)(?:tests?|__tests__|specs?|e2e)/|(?:^|/)test_[^/]+\.py$|_test\.(?:py|go|rb|exs|dart|cc|cpp)$|\.(?:test|spec)\.[cm]?[jt]sx?$|(?:Test|Tests|Spec)\.(?:java|kt|cs|swift|scala|php)$|_spec\.rb$|(?:^|/)conftest\.py$"
DOC_FILE = r"(?i)\.(?:md|mdx|rst|txt|adoc)$|(?:^|/)docs?/|(?:^|/)(?:LICENSE|CHANGELOG|README)[^/]*$"
FIXTURE_FILE = r"(?i)(?:^|/)(?:fixtures?|testdata|__snapshots__|snapshots|goldens?|cassettes)/|\.snap$"
NOT_RUN = r"(?i)\.(?:md|mdx|rst|txt|adoc|svg|png|jpe?g|gif|webp|ico|pdf|csv|lock|log|gitignore)$"
SECRET_PATH = r"(?i)(?:^|/)\.env(?:\.(?!example$|sample$|template$)[^/]+)?$|(?:^|/)\.ssh/|(?:^|/)id_(?:rsa|dsa|ecdsa|ed25519)$|(?:^|/)\.aws/credentials$|(?:^|/)\.netrc$|(?:^|/)\.npmrc$|(?:^|/)\.pypirc$|(?:^|/)\.git-credentials$|(?:^|/)\.kube/config$|(?:^|/)\.docker/config\.json$|\.(?:pem|p12|pfx|key)$"
LOCKFILES = {"npm": "package-lock.json", "pnpm": "pnpm-lock.yaml", "yarn": "yarn.lock", "bun": "bun.lock", "uv": "uv.lock", "poetry": "poetry.lock", "pipenv": "Pipfile.lock", "cargo": "Cargo.lock", "go": "go.sum", "bundle": "Gemfile.lock", "composer": "composer.lock"}
REGISTRIES = {"npm": "registry.npmjs.org", "pnpm": "registry.npmjs.org", "yarn": "registry.yarnpkg.com", "bun": "registry.npmjs.org", "npx": "registry.npmjs.org", "pip": "pypi.org", "pip3": "pypi.org", "uv": "pypi.org", "poetry": "pypi.org", "cargo": "crates.io", "go": "proxy.golang.org", "gem": "rubygems.org", "bundle": "rubygems.org", "composer": "packagist.org", "brew": "formulae.brew.sh"}
SKIP_MARK = r"\b(?:it|test|describe)\.(?:skip|only|todo)\b|\bx(?:it|describe|test)\s*\(|@pytest\.mark\.(?:skip|xfail)|@unittest\.skip|\bt\.Skip\(|#\[ignore\]|@Ignore\b|@Disabled\b|\bpytest\.skip\("
ASSERT = r"\bassert\w*\b|\bexpect\s*\(|\bshould\b|\brequire\.\w+\("


def is_test_file(path: Column) -> Column:
    return F.rlike(path, F.lit(TEST_FILE))


def is_doc(path: Column) -> Column:
    return F.rlike(path, F.lit(DOC_FILE))


def is_fixture(path: Column) -> Column:
    return F.rlike(path, F.lit(FIXTURE_FILE))


def is_secret_path(path: Column) -> Column:
    return F.rlike(path, F.lit(SECRET_PATH))


def is_stale_source(path: Column, status: Column, metadata_only: Column) -> Column:
    """Whether a write can make an earlier test run stale (92)."""
    return (status == "ok") & ~metadata_only & ~is_test_file(path) & ~is_doc(path) & ~F.rlike(path, F.lit(NOT_RUN))


def canon(path: Column, cwd: Column, home: str = "/root") -> Column:
    """An absolute path without `.`, `..` and doubled slashes (282, 284)."""
    whole = F.when(F.startswith(path, F.lit("/")), path).when(path == "~", F.lit(home)).when(F.startswith(path, F.lit("~/")), F.concat(F.lit(home), F.substring(path, 2, 1_000_000))).otherwise(F.concat_ws("/", cwd, path))
    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def is_under(child: Column, parent: Column) -> Column:
    """Containment on segment boundaries (285)."""
    return (child == parent) | F.startswith(child, F.concat(parent, F.lit("/")))


def classify_scope(path: Column, cwd: Column, repo_root: Column, home: str = "/root") -> Column:
    """repo, worktree, temporary, home, other repository or outside, in that order (283, 396)."""
    return (
        F.when(is_under(path, repo_root) & F.contains(path, F.lit("/.git/")), "git")
        .when(is_under(path, repo_root), "repo")
        .when(is_under(path, cwd), "cwd")
        .when(F.rlike(path, F.lit(r"^/(?:tmp|var/tmp|private/tmp|var/folders|dev/shm)(?:/|$)")), "scratch")
        .when(F.rlike(path, F.lit(r"/worktrees?/")), "worktree")
        .when(is_under(path, F.lit(home)), "home")
        .when(F.rlike(path, F.lit(r"^/(?:etc|usr|bin|sbin|opt|lib|System|Library)(?:/|$)")), "system")
        .otherwise("outside")
    )


def commands(calls: DataFrame) -> DataFrame:
    """Shell calls with their segments (171)."""
    own = calls.where((F.col("kind") == "shell") & (F.trim(F.coalesce("command", F.lit(""))) != ""))
    if "background" not in own.columns:
        own = own.withColumn("background", F.lit(False))
    return own.withColumn("segments", shell.segments(F.col("command"), F.col("cwd"), F.col("exit"), F.col("output"), F.col("background")))


def exploded(commands_: DataFrame) -> DataFrame:
    """One row a segment, with its place in the call (380)."""
    cols = [c for c in commands_.columns if c not in ("segments", "exit", "exit_source", "cwd", "background")]
    return commands_.select(*cols, F.col("exit").alias("call_exit"), F.posexplode("segments").alias("ordinal", "s")).select(*cols, "call_exit", "ordinal", *[F.col(f"s.{c}").alias(c) for c in ("raw", "program", "argv", "family", "runner", "scope", "targets", "link", "piped", "sink", "background", "suppressed", "snapshot_update", "may_write", "may_run_tests", "opaque_write", "cwd", "exit", "exit_source", "ran", "redirects", "heredoc")])


def segment_status(segments: DataFrame) -> Column:
    """ok, failed or unknown of what a segment did (395)."""
    return F.when(F.col("denied") | ~F.coalesce(F.col("ran"), F.lit(True)), "failed").when(F.col("exit") == 0, "ok").when(F.col("exit").isNull(), "unknown").otherwise("failed")


def writes(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """Files created, updated, deleted, renamed, by tools and by the shell (182-194)."""
    tool = calls.where(F.col("kind").isin("write", "edit")).select(*KEYS, F.lit(0).alias("ordinal"), F.explode("paths").alias("p"), "cwd", F.when(F.col("denied") | F.col("is_error"), "failed").otherwise("ok").alias("status"), F.when(F.col("kind") == "write", "create").otherwise("update").alias("op"), F.lit("tool").alias("source"), F.lit(False).alias("metadata_only"))
    status = segment_status(segments)
    base = [*KEYS, "ordinal"]
    plain = F.filter("argv", lambda a: ~F.startswith(a, F.lit("-")))
    last = F.try_element_at(plain, F.lit(-1))

    def rows(cond: Column, paths: Column, op: str, metadata: bool = False) -> DataFrame:
        return segments.where(cond).select(*base, F.explode(paths).alias("p"), "cwd", status.alias("status"), F.lit(op).alias("op"), F.lit("shell").alias("source"), F.lit(metadata).alias("metadata_only"))

    out_ops = F.filter("redirects", lambda r: F.rlike(r["op"], F.lit(r"^\d*&?>")) & ~F.startswith(r["target"], F.lit("/dev/")) & ~F.rlike(r["target"], F.lit(r"^&?\d$")))
    program = F.col("program")
    inplace = (program == "sed") & F.exists("argv", lambda a: F.rlike(a, F.lit(r"^-[A-Za-z]*i|^--in-place")))
    tool_name = F.create_map(*[F.lit(x) for kv in LOCKFILES.items() for x in kv])
    shells = [
        rows(F.size(out_ops) > 0, F.transform(out_ops, lambda r: r["target"]), "update"),
        rows(program == "tee", plain, "update"),
        rows(inplace, F.slice(plain, 2, 1000), "update"),
        rows(program.isin("cp", "mv", "install", "rsync") & (F.size(plain) > 1), F.array(last), "create"),
        rows((program == "mv") & (F.size(plain) > 1), F.slice(plain, 1, F.size(plain) - 1), "delete"),
        rows(program.isin("rm", "unlink", "rmdir"), plain, "delete"),
        rows((program == "git") & (F.try_element_at(plain, F.lit(1)) == "rm"), F.slice(plain, 2, 1000), "delete"),
        rows(program.isin("mkdir", "touch", "ln", "chmod", "chown"), F.when(program.isin("chmod", "chown"), F.slice(plain, 2, 1000)).otherwise(plain), "update", True),
        rows(program.isin("curl", "wget"), F.filter(F.transform("argv", lambda a, i: F.when(F.get("argv", i - 1).isin("-o", "-O", "--output", "--output-document") & (i > 0), a)), lambda x: x.isNotNull()), "create"),
        rows((F.col("family") == "format") & F.exists("argv", lambda a: a.isin("--write", "-w", "--fix", "-i")) | program.isin("black", "isort", "rustfmt"), F.filter(plain, lambda a: F.contains(a, F.lit("/")) | F.contains(a, F.lit("."))), "update"),
        rows((F.col("family") == "install") & F.try_element_at(tool_name, program).isNotNull(), F.array(F.try_element_at(tool_name, program)), "update"),
    ]
    every = tool
    for s in shells:
        every = every.unionByName(s)
    path = canon(F.col("p"), F.col("cwd"))
    return every.where("p IS NOT NULL AND p <> '' AND cwd IS NOT NULL").withColumn("path", path).select(*base, "path", "op", "status", "source", "metadata_only", is_test_file(path).alias("is_test"), is_doc(path).alias("is_doc"), is_fixture(path).alias("is_fixture"), is_secret_path(path).alias("is_secret"))


def apply_reverts(writes_: DataFrame, segments: DataFrame) -> DataFrame:
    """Mark writes that a later `git checkout/restore/reset --hard/stash` took back: the first such (114)."""
    plain = F.filter("argv", lambda a: ~F.startswith(a, F.lit("-")))
    verb = F.try_element_at(plain, F.lit(1))
    back = segments.where((F.col("program") == "git") & F.coalesce(F.col("exit") == 0, F.lit(False)) & (verb.isin("checkout", "restore", "stash") | ((verb == "reset") & F.array_contains("argv", "--hard"))))
    named = F.filter(F.slice(plain, 2, 1000), lambda a: F.contains(a, F.lit(".")) | F.contains(a, F.lit("/")))
    all_of = (F.size(named) == 0) | F.array_contains(named, ".")
    reverts = back.where((verb != "checkout") | (F.size(named) > 0)).select("session_key", F.col("seq").alias("rev_seq"), F.when(all_of, F.array("cwd")).otherwise(F.transform(named, lambda p: canon(p, F.col("cwd")))).alias("covers"))
    reverts = reverts.select("session_key", "rev_seq", F.explode("covers").alias("cover"))
    hit = writes_.join(reverts, "session_key").where((F.col("rev_seq") > F.col("seq")) & is_under(F.col("path"), F.col("cover")))
    first = hit.groupBy("session_key", "seq", "ordinal", "path").agg(F.min("rev_seq").alias("reverted_by"))
    return writes_.join(first, ["session_key", "seq", "ordinal", "path"], "left")


def test_runs(segments: DataFrame) -> DataFrame:
    """Runs of test runners with counts and a verdict (195-200)."""
    own = segments.where((F.col("family") == "test") & F.coalesce("ran", F.lit(True)) & ~F.col("denied"))
    parsed = own.withColumn("r", runners.parsed_run(F.col("runner"), F.col("output")))
    red = (F.col("r.failed") > 0) | (F.col("r.errors") > 0) | (F.col("r.suites_failed") > 0)
    bad_exit = F.coalesce((F.col("exit") != 0) & ~F.col("piped"), F.lit(False))
    ok_exit = F.coalesce(F.col("exit") == 0, F.lit(False)) | F.col("piped")
    some = F.col("r.total").isNotNull()
    alone = (F.count("*").over(Window.partitionBy("session_key", "seq")) == 1) & ~F.col("piped") & ~F.col("suppressed") & ~F.col("truncated")
    green = F.when(F.col("snapshot_update"), "red").when(some & red, "red").when(bad_exit, "red").when(some & (F.col("r.total") == 0), "red").when(some & (ok_exit | ~F.col("timed_out")), "green").when(F.coalesce(F.col("exit") == 0, F.lit(False)) & alone, "green").otherwise("unknown")
    conclusive = ~F.col("snapshot_update") & ((some & (red | ok_exit | ~F.col("timed_out"))) | bad_exit)
    return parsed.select(*KEYS, "ordinal", "raw", F.coalesce("r.runner", "runner").alias("runner"), "scope", "targets", "exit", "exit_source", F.col("r.passed").alias("passed"), F.col("r.failed").alias("failed"), F.col("r.skipped").alias("skipped"), F.col("r.errors").alias("errors"), F.col("r.total").alias("total"), green.alias("green"), F.coalesce(conclusive, F.lit(False)).alias("conclusive"), F.coalesce("background", F.lit(False)).alias("background"), "snapshot_update")


def checks(segments: DataFrame) -> DataFrame:
    """Runs of linters, type checkers, builds and formatters (201, 202, 358, 359)."""
    families = {"lint": "lint", "typecheck": "type", "build": "build", "format": "format"}
    own = segments.where(F.col("family").isin(*families) & F.coalesce("ran", F.lit(True)) & ~F.col("background") & ~F.col("denied"))
    tool = F.when((F.col("program") == "ruff") & (F.col("family") == "format"), "ruff-format").otherwise(F.col("program"))
    got = own.withColumn("c", runners.parsed_check(tool, F.col("output")))
    owns_exit = ~F.col("piped")
    green = F.when(F.coalesce((F.col("exit") != 0) & owns_exit, F.lit(False)), "red").when(F.col("c.green").isNotNull(), F.when(F.col("c.green"), "green").otherwise("red")).when(F.coalesce((F.col("exit") == 0) & owns_exit, F.lit(False)), "green").otherwise("unknown")
    positional = F.filter("argv", lambda a: ~F.startswith(a, F.lit("-")) & (F.contains(a, F.lit("/")) | F.contains(a, F.lit("."))) & ~a.isin(".", "./"))
    mapped = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("family")]
    return got.select(*KEYS, "ordinal", "raw", tool.alias("tool"), mapped.alias("check_family"), F.when(F.size(positional) > 0, "subset").otherwise("full").alias("scope"), "exit", green.alias("green"), F.col("c.summary").alias("summary"))


def git_facts(segments: DataFrame) -> DataFrame:
    """What git and pull-request commands did, without repeats (142, 203)."""
    plain = F.filter("argv", lambda a: ~F.startswith(a, F.lit("-")))
    verb = F.try_element_at(plain, F.lit(1))
    has = lambda *flags: F.exists("argv", lambda a: a.isin(*flags))
    git, gh = F.col("program") == "git", F.col("program") == "gh"
    op = (
        F.when(git & (verb == "commit") & has("--amend"), "amend")
        .when(git & (verb == "commit"), "commit")
        .when(git & (verb == "push") & has("-f", "--force", "--force-with-lease"), "force-push")
        .when(git & (verb == "push"), "push")
        .when(gh & (verb == "pr") & (F.try_element_at(plain, F.lit(2)) == "create"), "pr")
        .when(git & (verb == "tag"), "tag")
        .when(git & ((verb == "branch") | ((verb == "checkout") & has("-b", "-B")) | ((verb == "switch") & has("-c", "-C"))), "branch")
        .when(git & verb.isin("stash", "merge", "rebase", "reset", "checkout", "clean", "restore", "switch"), verb)
    )
    got = segments.withColumn("op", op).where("op IS NOT NULL")
    out = F.coalesce("output", F.lit(""))
    sha = F.regexp_extract(out, r"(?m)^\[[^\]\n]* ([0-9a-f]{7,40})\]", 1)
    pr = F.regexp_extract(out, r"/pull/(\d+)", 1)
    target = F.try_element_at(plain, F.lit(-1))
    ok = F.when(F.col("denied"), False).when(F.col("exit").isNotNull(), F.col("exit") == 0)
    rows = got.select(*KEYS, "ordinal", "op", ok.alias("ok"), F.when(sha != "", sha).alias("sha"), F.when(pr != "", pr.cast("int")).alias("pr_number"), F.when(F.col("op").isin("branch", "tag") & (F.size(plain) > 1), target).when(F.col("op").isin("push", "force-push") & (F.size(plain) > 2), target).alias("ref"), F.when(F.col("op").isin("push", "force-push") & (F.size(plain) > 1), F.try_element_at(plain, F.lit(2))).alias("remote"))
    key = F.coalesce(F.substring("sha", 1, 7), F.col("pr_number").cast("string"), F.concat_ws("|", F.col("ref"), F.col("ok").cast("string"), F.col("seq").cast("string")))
    w = Window.partitionBy("session_key", "op", "_key").orderBy("seq", "ordinal")
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def network_facts(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """Hosts that were contacted or tried, private ones left out, once a call (143, 204-206, 393, 394)."""
    registry = F.create_map(*[F.lit(x) for kv in REGISTRIES.items() for x in kv])
    status = F.when(F.coalesce(F.col("exit") == 0, F.lit(False)) | (F.length(F.coalesce("output", F.lit(""))) > 0), "contacted").otherwise("attempted")
    words = segments.select(*KEYS, F.explode("argv").alias("word"), F.lit("shell").alias("via"), status.alias("status")).select(*KEYS, host_of(F.col("word")).alias("host"), "via", "status")
    installs = segments.where("family = 'install'").select(*KEYS, F.try_element_at(registry, F.col("program")).alias("host"), F.lit("registry").alias("via"), status.alias("status"))
    web = calls.where((F.col("kind") == "web") & F.col("url").isNotNull()).select(*KEYS, host_of(F.col("url")).alias("host"), F.lit("tool").alias("via"), F.when(F.col("is_error"), "attempted").otherwise("contacted").alias("status"))
    return words.unionByName(installs).unionByName(web).where(F.col("host").isNotNull() & ~is_private_host(F.col("host"))).groupBy(*KEYS, "host", "via").agg(F.min(F.when(F.col("status") == "contacted", "contacted").otherwise("zattempted")).alias("s")).select(*KEYS, "host", "via", F.when(F.col("s") == "contacted", "contacted").otherwise("attempted").alias("status"))


def danger_flags(segments: DataFrame) -> DataFrame:
    """Commands that can do harm, without repeats (144, 152, 153, 210-213, 392)."""
    has = lambda *flags: F.exists("argv", lambda a: a.isin(*flags))
    joined = F.array_join("argv", " ")
    plain = F.filter("argv", lambda a: ~F.startswith(a, F.lit("-")))
    verb = F.try_element_at(plain, F.lit(1))
    program = F.col("program")
    git = program == "git"
    recursive = (program == "rm") & F.exists("argv", lambda a: F.rlike(a, F.lit(r"^-[a-zA-Z]*[rR]|^--recursive$")))
    grave = F.exists(plain, lambda p: F.rlike(p, F.lit(r"^(?:/|~|~/|/\*|\$HOME/?|/(?:etc|usr|var|home|bin|lib|opt|root)/?\**|\.\./.*|.*/\.git/?|\.git/?)$")))
    w = Window.partitionBy("session_key", "seq").orderBy("ordinal")
    fetched = F.lag(program.isin("curl", "wget") & F.col("piped")).over(w)
    kinds = F.array(
        F.when(recursive & grave, F.struct(F.lit("rm-rf").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(recursive & ~grave, F.struct(F.lit("rm-rf").alias("kind"), F.lit("cleanup").alias("tier"))),
        F.when(git & (verb == "reset") & has("--hard"), F.struct(F.lit("git-reset-hard").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(git & (verb == "clean") & F.exists("argv", lambda a: F.rlike(a, F.lit(r"^-[a-zA-Z]*f|^--force$"))), F.struct(F.lit("git-clean").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(git & (verb == "push") & has("-f", "--force", "--force-with-lease"), F.struct(F.lit("force-push").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(git & (verb == "branch") & has("-D"), F.struct(F.lit("branch-delete").alias("kind"), F.lit("cleanup").alias("tier"))),
        F.when(git & has("--no-verify"), F.struct(F.lit("no-verify").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(git & verb.isin("filter-branch", "filter-repo"), F.struct(F.lit("history-rewrite").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(F.rlike(F.col("raw"), F.lit(r"^\s*(?:sudo|doas)\b")), F.struct(F.lit("sudo").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(program.isin("sh", "bash", "zsh") & F.col("sink") & F.coalesce(fetched, F.lit(False)), F.struct(F.lit("pipe-to-shell").alias("kind"), F.lit("danger").alias("tier"))),
        F.when((program == "chmod") & F.rlike(joined, F.lit(r"(?:^| )(?:-R )?0?777(?: |$)")), F.struct(F.lit("chmod-777").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(program.isin("cat", "cp", "scp", "base64", "less", "head", "tail", "curl", "rsync") & F.exists(plain, lambda p: is_secret_path(F.regexp_replace(p, "^@", ""))), F.struct(F.lit("secret-read").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(F.exists("redirects", lambda r: F.rlike(r["op"], F.lit(">")) & is_secret_path(r["target"])), F.struct(F.lit("secret-write").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(program.isin("mkfs", "dd") & F.rlike(joined, F.lit(r"/dev/(?:sd|nvme|disk)")) | F.startswith(program, F.lit("mkfs.")), F.struct(F.lit("disk-write").alias("kind"), F.lit("danger").alias("tier"))),
        F.when(program.isin("npm", "pnpm", "yarn", "cargo", "twine", "gem") & verb.isin("publish", "upload", "push"), F.struct(F.lit("publish").alias("kind"), F.lit("danger").alias("tier"))),
    )
    flagged = segments.where(~F.col("denied")).withColumn("_f", F.array_compact(kinds)).select(*KEYS, "ordinal", F.col("raw").alias("detail"), F.explode("_f").alias("f"))
    return flagged.select(*KEYS, F.col("f.kind").alias("kind"), F.col("f.tier").alias("tier"), "detail").dropDuplicates(["session_key", "seq", "kind", "detail"])


def integrity_signals(calls: DataFrame, writes_: DataFrame, runs: DataFrame) -> DataFrame:
    """Signs that evidence was bent: tests deleted, skipped, fewer asserts or tests, edits after the last green run (150, 151, 207-209)."""
    base = ["session_key", "turn_index", "seq"]
    deleted = writes_.where("op = 'delete' AND is_test AND status = 'ok'").select(*base, F.lit("test-deleted").alias("kind"), F.col("path").alias("detail"))
    snapshots = writes_.where("is_fixture AND op <> 'delete' AND status = 'ok' AND NOT is_test").select(*base, F.lit("snapshot-edited").alias("kind"), F.col("path").alias("detail"))
    added = F.flatten(F.transform(F.coalesce("edits", F.array().cast("array<struct<old:string,new:string>>")), lambda e: F.split(F.coalesce(e["new"], F.lit("")), "\n")))
    removed = F.flatten(F.transform(F.coalesce("edits", F.array().cast("array<struct<old:string,new:string>>")), lambda e: F.split(F.coalesce(e["old"], F.lit("")), "\n")))
    edits = calls.where((F.col("kind") == "edit") & ~F.col("is_error") & ~F.col("denied")).withColumn("path", F.get("paths", F.lit(0))).where(is_test_file(F.col("path"))).withColumn("added", F.filter(added, lambda x: F.trim(x) != "")).withColumn("removed", F.filter(removed, lambda x: F.trim(x) != ""))
    marks = lambda c: F.size(F.filter(c, lambda x: F.rlike(x, F.lit(SKIP_MARK))))
    asserts = lambda c: F.size(F.filter(c, lambda x: F.rlike(x, F.lit(ASSERT)) & ~F.rlike(x, F.lit(r"^\s*(?:import|from|//|#|\*)"))))
    skipped = edits.where((marks("added") > marks("removed"))).select(*base, F.lit("test-skipped").alias("kind"), F.col("path").alias("detail"))
    fewer = edits.where(asserts("added") < asserts("removed")).select(*base, F.lit("asserts-removed").alias("kind"), F.col("path").alias("detail"))
    whole = runs.where("scope = 'full' AND total IS NOT NULL")
    w = Window.partitionBy("session_key", "runner").orderBy("seq", "ordinal")
    drops = whole.withColumn("before", F.lag("total").over(w)).withColumn("since", F.lag("seq").over(w)).where("before > total")
    tests = writes_.where("is_test AND status = 'ok'").select("session_key", F.col("seq").alias("w_seq"))
    dropped = drops.join(tests, (drops["session_key"] == tests["session_key"]) & (F.col("w_seq") > F.col("since")) & (F.col("w_seq") < F.col("seq")), "left_semi").select(*base, F.lit("test-count-drop").alias("kind"), F.concat_ws(" → ", F.col("before").cast("string"), F.col("total").cast("string")).alias("detail"))
    last_green = runs.where("green = 'green'").groupBy("session_key").agg(F.max("seq").alias("g"))
    late = writes_.where(is_stale_source(F.col("path"), F.col("status"), F.col("metadata_only"))).join(last_green, "session_key").where("seq > g").groupBy("session_key").agg(F.max_by(F.struct("turn_index", "seq", "path"), F.col("seq")).alias("x")).select("session_key", "x.turn_index", "x.seq", F.lit("edit-after-green").alias("kind"), F.col("x.path").alias("detail"))
    out = deleted
    for part in (snapshots, skipped, fewer, dropped, late):
        out = out.unionByName(part)
    return out


def turn_index_facts(writes_: DataFrame, runs: DataFrame, commands_: DataFrame) -> DataFrame:
    """Per turn: last writes, last runs, counts, changed files (130)."""
    ok = F.col("status") == "ok"
    w = writes_.groupBy("session_key", "turn_index").agg(F.max(F.when(ok & ~F.col("metadata_only"), F.col("seq"))).alias("last_write"), F.max(F.when(is_stale_source(F.col("path"), F.col("status"), F.col("metadata_only")), F.col("seq"))).alias("last_source_write"), F.count_if(ok).alias("n_writes"), F.array_sort(F.collect_set(F.when(ok & ~F.col("metadata_only"), F.col("path")))).alias("files_changed"))
    r = runs.groupBy("session_key", "turn_index").agg(F.max(F.when(F.col("green") == "green", F.col("seq"))).alias("last_green"), F.max(F.when(F.col("green") == "red", F.col("seq"))).alias("last_red"), F.count("*").alias("n_runs"))
    c = commands_.groupBy("session_key", "turn_index").agg(F.count("*").alias("n_commands"))
    return w.join(r, ["session_key", "turn_index"], "full").join(c, ["session_key", "turn_index"], "full").fillna(0, ["n_writes", "n_runs", "n_commands"])
