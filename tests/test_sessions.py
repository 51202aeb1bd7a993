"""Edges of the timeline, selection and patch operators: nulls, empty inputs, caps, ties."""

import time

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import patches, rates, selection, timeline
from tracemill.sources import messages


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def diff(spark, old, new):
    return one(spark, patches.line_diff(F.col("o"), F.col("n")), o=old, n=new)


def test_line_diff(spark):
    assert diff(spark, "a\nb\nc", "a\nX\nY\nc")[:3] == (["X", "Y"], ["b"], 1)
    assert diff(spark, "a\na", "a\na\na")[:2] == (["a"], [])  # what both ends share is not counted twice
    assert diff(spark, "a\nb", "a")[:2] == ([], ["b"])
    assert diff(spark, "", "x")[:2] == (["x"], [""])
    assert diff(spark, "same", "same") is None and diff(spark, None, "x") is None
    long = diff(spark, "\n".join(f"o{i}" for i in range(900)), "\n".join(f"n{i}" for i in range(1500)))
    assert (len(long.added), len(long.removed), long.truncated) == (1500, 500, True)
    full = diff(spark, "o", "\n".join(f"n{i}" for i in range(2500)))
    assert (len(full.added), len(full.removed), full.truncated) == (2000, 0, True)


def test_structured_patch(spark):
    read = lambda j: one(spark, patches.structured_patch(F.col("j")), j=j)
    got = read('[{"lines": [" a", "+b", "-c", "+"]}, {"other": 1}, {"lines": ["-d"]}]')
    assert (got.added, got.removed, got.hunks, got.truncated) == (["b", ""], ["c", "d"], 2, False)
    assert read("[]") is None and read(None) is None and read('[{"x": 1}]') is None


def test_result_text_and_input(spark):
    read = lambda j: one(spark, patches.result_text(F.col("j"), F.lit("else")), j=j)
    assert read('"say \\"x\\""').text == 'say "x"'
    assert read('[{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]').text == "a\nb"
    assert read('{"k": 1}').text == "else" and read(None).text == "else" and read("[]").text == ""
    assert read('"' + "y" * 9000 + '"') == ("y" * 8192, True)
    assert one(spark, patches.pick_input(F.col("j"), ["command", "deep"]), j='{"command": "ls", "secret": "x", "deep": {"a": 1}}') == {"command": "ls", "deep": '{"a":1}'}


def test_hash_paths(spark):
    hide = lambda t, cwd="/w": one(spark, patches.hash_paths(F.col("t"), "s", F.col("c")), t=t, c=cwd)
    assert hide("/w/a.py and /w") == "a.py and ." and hide("none here") == "none here" and hide("") == "" and hide(None) is None
    assert hide("/wide/a.py").startswith("p:") and hide("/wide/a.py").endswith("/a.py") and hide("/w/a", "") .startswith("p:")
    assert hide("/x/a /x/a").split()[0] == hide("/x/a /x/a").split()[1]
    assert hide("C:\\u\\me\\f.txt").endswith("/f.txt")


def test_canonical_json(spark):
    read = lambda j: one(spark, text.canonical_json(F.col("j")), j=j)
    assert read('{"b": {"z": 1, "y": [ ]}, "a": "ü"}') == '{"a":"ü","b":{"y":[],"z":1}}'
    assert read("{broken") is None and read(None) is None


CALL = "session_key string, turn_index int, seq long, agent_id string"


def test_post_final(spark):
    calls = spark.createDataFrame([("s", 0, i, "a" if i < 4 else None) for i in range(6)] + [("t", 0, 9, None)], CALL)
    turns = spark.createDataFrame([("s", 0, 2), ("t", 0, None)], "session_key string, turn_index int, final_seq long")
    marked = timeline.mark_post_final(calls, turns)
    writes = spark.createDataFrame([("s", 4, "p", "ok", False), ("s", 5, "p", "ok", False), ("s", 5, "q", "ok", True), ("s", 5, "", "ok", False), ("s", 1, "r", "ok", False)], "session_key string, seq long, path string, status string, metadata_only boolean")
    runs = spark.createDataFrame([("s", 5), ("s", 5)], "session_key string, seq long")
    got = {r.agent_id: (r.tool_calls, r.files, r.test_runs) for r in timeline.post_final_groups(marked, writes, runs).collect()}
    assert got == {"a": (1, 0, 0), None: (2, 1, 2)}
    assert timeline.events_before(calls, F.lit(2)).count() == 3


def test_cap(spark):
    rows = spark.createDataFrame([("s", i, i in (1, 2)) for i in range(8)], "k string, seq long, must boolean")
    got = sorted((r.seq, r.hidden) for r in timeline.cap(rows, ["k"], F.col("must"), 3).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 4), (7, 0)]
    assert timeline.cap(rows, ["k"], F.col("must"), 8).where("hidden > 0").count() == 0
    assert [r.seq for r in timeline.cap(rows, ["k"], F.col("must"), 1).where("hidden = 0").orderBy("seq").collect()] == [1, 2]  # what is protected stays beyond the cap


def test_flags_without_facts(spark):
    calls = spark.createDataFrame([("s", 1, "edit", None, False, True), ("s", 2, "shell", 3, False, None)], "session_key string, seq long, kind string, exit int, is_error boolean, background boolean")
    assert [r.flags for r in timeline.with_flags(calls, {}).orderBy("seq").collect()] == [["write", "background"], ["error"]]
    assert timeline.full_keys(calls, ["seq"], 1).count() == 1


SESSION = "session_key string, session_id string, short_id string, file string, harness string, cwds array<string>, ended_ms long"


def test_selectors(spark):
    s = spark.createDataFrame([("x:1", "ABCDEF-1", "abcdef", "rollout-9", "x", ["/root/p"], 5), ("y:1", "ABCDEF-1", None, None, "y", ["/q"], None), ("y:2", "abcd", "zzzz", None, "y", [], 9)], SESSION)
    typed = spark.createDataFrame([("abcdef-1",), ("ABCD",), ("abcde",), ("rollo",), ("zz",), ("nope!",), ("zzzz",), ("zzzz",)], "selector string")
    got = {r.selector: (r.status, r.session_key) for r in selection.resolve_ids(s, typed).collect()}
    assert got == {"abcdef-1": ("ambiguous", None), "ABCD": ("found", "y:2"), "abcde": ("ambiguous", None), "rollo": ("found", "x:1"), "zz": ("too-short", None), "nope!": ("not-found", None), "zzzz": ("found", "y:2")}
    keys = lambda df: sorted(r.session_key for r in df.collect())
    assert keys(selection.by_project(s, "~/p")) == ["x:1"] and keys(selection.by_project(s, " ")) == ["x:1", "y:1", "y:2"]
    assert keys(selection.by_harness(s, ["y"])) == ["y:1", "y:2"] and len(keys(selection.by_harness(s, []))) == 3
    turns = spark.createDataFrame([("x:1", 0, True), ("x:1", 1, False), ("y:2", 0, False), ("y:2", 1, None)], "session_key string, turn_index int, is_done boolean")
    assert keys(selection.latest_done(s, turns)) == ["x:1"]
    assert sorted(map(tuple, selection.select_turns(turns).collect())) == [("x:1", 0), ("y:2", 1)]
    assert selection.select_turns(turns, 1).count() == 2
    did = spark.createDataFrame([("s", 0, True), ("s", 0, False), ("s", 1, False)], "session_key string, turn_index int, warn boolean")
    assert sorted(map(tuple, selection.has_warnings(did).collect())) == [("s", 0, True), ("s", 1, False)]


def test_selectors_with_one_beginning(spark):
    n = 60_000  # as pairs of names and selectors with the same first characters: 3.6 billion
    s = spark.range(n).select(F.col("id").alias("session_key"), F.col("id").cast("string").alias("session_id"), F.lit(None).cast("string").alias("short_id"), F.concat(F.lit("log-"), "id").alias("file"))
    began = time.monotonic()
    got = {r.selector: (r.status, r.session_key) for r in selection.resolve_ids(s, s.select(F.upper("file").alias("selector")).union(s.select(F.substring("session_id", 1, 2)))).collect()}
    assert time.monotonic() - began < 60
    want = {f"LOG-{i}": ("found", i) if i and 10 * i >= n else ("found", 0) if not i else ("ambiguous", None) for i in range(n)}
    assert got == want | {str(i): ("found", i) for i in range(100)}  # whole ids of two characters are none too short


def test_selectors_of_odd_lengths(spark):
    s = spark.createDataFrame([("a", "", "x", "f"), ("b", "Ab", "ab", "abcd"), ("c", "ab", "abcdé", None), ("d", None, None, None)], "session_key string, session_id string, short_id string, file string")
    typed = spark.createDataFrame([("",), (None,), ("x",), ("AB",), ("abcd",), ("ABCDÉ",), ("abcdef",), ("f",)], "selector string")
    got = {r.selector: (r.status, r.session_key) for r in selection.resolve_ids(s, typed).collect()}
    assert got == {"": ("found", "a"), None: ("not-found", None), "x": ("too-short", None), "AB": ("ambiguous", None), "abcd": ("ambiguous", None), "ABCDÉ": ("found", "c"), "abcdef": ("not-found", None), "f": ("too-short", None)}
    assert selection.resolve_ids(s, typed.limit(0)).count() == 0


def test_confusion(spark):
    schema = "rule string, doc int, path string"
    want = spark.createDataFrame([("r", 1, "a"), ("r", 1, "a"), ("r", 2, None), ("q", 3, "b")], schema)
    found = spark.createDataFrame([("r", 1, "a"), ("r", 2, None), ("r", 2, None), ("p", 1, "a")], schema)
    got = {r.rule: (r.tp, r.fp, r.fn) for r in rates.confusion(want, found, ["doc", "path"]).collect()}
    assert got == {"r": (2, 1, 1), "q": (0, 0, 1), "p": (0, 1, 0)}


def test_late_exits(spark):
    calls = spark.createDataFrame([("s", 1, 0, "c1", "b1", None, "unknown"), ("s", 2, 0, "c2", "b1", None, "unknown"), ("s", 3, 0, "c3", None, 0, "interpreted"), ("t", 1, 0, "c1", "b1", None, "unknown")], "session_key string, seq long, block int, tool_call_id string, background_task_id string, exit int, exit_source string")
    notes = spark.createDataFrame([("s", 5, "b1", None), ("s", 6, "b1", 2), ("s", 7, "b1", 3), ("s", 8, "", 9)], "session_key string, ord long, task_id string, exit int")
    got = {(r.session_key, r.tool_call_id): (r.exit, r.exit_source) for r in messages.apply_notifications(calls, notes).collect()}
    assert got == {("s", "c1"): (3, "notification"), ("s", "c2"): (None, "unknown"), ("s", "c3"): (0, "interpreted"), ("t", "c1"): (None, "unknown")}


def test_lines_beside_messages(spark):
    raw = ['{"type":"user","message":{"content":"go"}}', '{"type":"system","subtype":"turn_duration","durationMs":5}', '{"type":"system","subtype":"turn_duration"}', '{"type":"pr-link","prNumber":1}', '{"type":"attachment","attachment":{"type":"other","filename":"x"}}', '{"type":"attachment"}', '{"type":"system","subtype":"compact_boundary"}', '{"type":"system","subtype":"model_refusal_fallback","originalModel":"a"}']
    lines = spark.createDataFrame([("p/s.jsonl", i, v, False, False) for i, v in enumerate(raw)], "file string, seq long, value string, bad boolean, count_only boolean")
    n = messages.with_turns(messages.records(lines))
    assert [r.active_ms for r in messages.active_time(n).collect()] == [5]
    assert messages.pr_refs(n).count() == 0 and messages.edited_files(n).count() == 0 and messages.refusals(n).count() == 0
    assert [tuple(r)[3:] for r in messages.compactions(n).collect()] == [("unknown", 0, 0)]
