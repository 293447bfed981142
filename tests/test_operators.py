"""Decoding, the context machine, stores and the stream on small fixtures."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from runlens.functions import decode, text
from runlens.operators import lifecycle
from runlens.operators.context import resolve
from runlens.sources import deletion, store, trace
from runlens.streaming.stitch import _step

TRACE = b"""101 openat(AT_FDCWD, "\\x2f\\x61", O_RDONLY) = 3
101 access("\\x2f\\x62", R_OK <unfinished ...>
102 openat(AT_FDCWD, "\\x63", O_RDONLY) = -1 ENOENT (No such file)
101 <... access resumed>) = 0
101 --- SIGCHLD ---
101 +++ exited with 0 +++
nonsense
102 chdir("\\x2f" <unfinished ...>"""


def write_trace(tmp_path):
    (tmp_path / "runs/a1-1/raw").mkdir(parents=True)
    (tmp_path / "runs/a1-1/raw/trace.log").write_bytes(TRACE)
    return str(tmp_path)


def test_raw_lines_keep_numbers_and_kinds(spark, tmp_path):
    got = {r.line: r for r in trace.raw_observations(spark, write_trace(tmp_path)).collect()}
    assert [got[k].t for k in range(1, 9)] == ["C", "U", "C", "R", "S", "X", None, "U"]
    assert got[7].pid is None and got[4].op == "access"
    assert [got[k].terminated for k in (7, 8)] == [True, False]


def test_call_parts_and_paths(spark, tmp_path):
    rows = trace.raw_observations(spark, write_trace(tmp_path)).where("t = 'C'").withColumn("call", decode.call_parts(F.col("body")))
    got = rows.orderBy("line").select(decode.resolved_path(F.col("call.args")).alias("p"), decode.outcome(F.col("call.returned")).alias("o")).collect()
    assert [tuple(r) for r in got] == [("/a", "success"), ("relative:c [cwd unresolved]", "ENOENT")]


def test_stitch_pairs_halves(spark, tmp_path):
    rows = trace.raw_observations(spark, write_trace(tmp_path)).where("pid is not null and t <> 'S'").select("run_id", "line", "pid", "t", "op")
    got = {(r.pid, r.line, r.end_line, r.state) for r in lifecycle.stitched(rows).collect()}
    assert got == {("101", 1, 1, "complete"), ("101", 2, 4, "stitched"), ("102", 3, 3, "complete"), ("102", 8, 8, "unfinished at end")}


def test_spawns_clear_calls_from_before_their_entry(spark):
    lines = [(1, "2", "U", "openat", None), (2, "1", "C", "fork", "2"), (3, "2", "R", "openat", None)]  # the pid was in use before
    lines += [(11, "5", "U", "clone", None), (12, "6", "U", "openat", None), (13, "5", "R", "clone", "6"), (14, "6", "R", "openat", None)]  # the child runs before its parent returns
    lines += [(21, "8", "U", "clone", None), (22, "9", "C", "fork", "8"), (23, "7", "U", "openat", None), (24, "8", "R", "clone", "7"), (25, "7", "R", "openat", None)]  # a cleared spawn introduces nobody
    df = spark.createDataFrame([("r", *x) for x in lines], "run_id string, line long, pid string, t string, op string, child string")
    got = {(r.pid, r.line, r.end_line): r.state for r in lifecycle.stitched(df).collect()}
    assert got[("2", 1, 1)] == "predates spawn entry" and got[("2", 3, 3)] == "unmatched resumed"
    assert got[("5", 11, 13)] == got[("6", 12, 14)] == "stitched"
    assert got[("8", 21, 21)] == "predates spawn entry" and got[("8", 24, 24)] == "unmatched resumed" and got[("7", 23, 25)] == "stitched"


def test_deleted_records_come_back(spark, tmp_path):
    root = str(tmp_path)
    for run_id, name in (("a1-1", "one"), ("a2-2", "two")):
        store.save_run(root, run_id, {"schema_version": 3, "id": run_id, "name": name, "state": "completed"}, [])
    first, second = deletion.isolate(root, "one"), deletion.isolate(root, "a2-2")
    assert trace.record_ids(root) == []
    assert {(d["id"], d["state"]) for d in deletion.deleted(root)} == {("a1-1", "isolated"), ("a2-2", "isolated")}
    assert deletion.restore(root, first) == "a1-1" and trace.record_ids(root) == ["a1-1"]
    store.save_run(root, "a3-3", {"schema_version": 3, "id": "a3-3", "name": "two", "state": "completed"}, [])
    with pytest.raises(deletion.Refused, match="two"):
        deletion.restore(root, second)  # its name is taken
    assert deletion.purge(root, second) == "a2-2" and deletion.deleted(root) == []
    with pytest.raises(deletion.Refused):
        deletion.purge(root, "../runs")
    (tmp_path / "deleted" / "a-1").mkdir()
    assert [d["state"] for d in deletion.deleted(root)] == ["damaged"]
    rows = deletion.deleted_table(spark, root).collect()
    assert [(r.ticket, r.state) for r in rows] == [("a-1", "damaged")]


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None


def test_stream_step_keeps_pending_calls_between_batches():
    state = State()
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["line", "t", "op"])])
    first = next(_step(("r", "1"), batch((1, "U", "openat")), state))
    second = next(_step(("r", "1"), batch((4, "R", "openat"), (5, "R", "openat")), state))
    assert first.empty and second.state.tolist() == ["stitched", "unmatched resumed"] and second.line.tolist() == [1, 5]
    assert not state.exists


def test_exit_spellings(spark):
    names = ["exited with 7", "killed by SIGKILL", "killed by SIGRTMIN+2 (core dumped)", "killed by SIGRT_3", "killed by SIGNEW"]
    rows = spark.createDataFrame([(n,) for n in names], "s string").select(decode.exit_fields(F.col("s")).alias("e")).collect()
    assert [tuple(r.e) for r in rows] == [(7, None), (None, 9), (None, 36), (None, 35), (None, None)]


def machine(*events):
    rows = []
    for i, e in enumerate(events):
        row = {"run_id": "r", "event_index": i, "line": i + 1, "end_line": i + 1, "pid": "1", "kind": "file", "operation": "openat", "path": "/x", "outcome": "success", "child_pid": None, "ordinal": 1, "origin": "Initial", "untrusted": False, "child_ordinal": None, "collision": False}
        rows.append(row | e)
    return resolve(pd.DataFrame(rows), "/w")[["cwd_before", "context_uncertain"]].values.tolist()


def test_context_follows_changes_and_children():
    child = {"pid": "2", "origin": "Spawned"}
    got = machine({}, {"kind": "cwd", "operation": "chdir", "path": "/n"}, {"kind": "spawn", "operation": "fork", "child_pid": "2", "child_ordinal": 1, "path": None}, child, {"kind": "cwd", "operation": "chdir", "path": "/m"}, child, {})
    assert [g[0] for g in got] == ["/w", "/w", "/n", "/n", "/n", "/n", "/m"]
    assert not any(g[1] for g in got)


def flags(*events):
    return [g[1] for g in machine(*events)]


SPAWN = {"kind": "spawn", "operation": "clone", "child_pid": "2", "child_ordinal": 1, "path": None}
CHILD = {"pid": "2", "origin": "Spawned"}


def test_fork_copy_is_open_until_the_child_acts():
    # The directory changes while the copy may still be under way: both sides and the spawn are in doubt.
    assert flags(SPAWN | {"end_line": 4}, {"kind": "cwd", "operation": "chdir", "path": "/n", "line": 2, "end_line": 2}, CHILD | {"line": 5, "end_line": 5}) == [True, True, True]
    # The child acted first, so the copy was complete.
    assert flags(SPAWN | {"end_line": 4}, CHILD | {"line": 2, "end_line": 2}, {"kind": "cwd", "operation": "chdir", "path": "/n", "line": 3, "end_line": 3}, CHILD | {"line": 5, "end_line": 5}) == [False] * 4


def test_split_halves_point_at_each_other():
    shared = SPAWN | {"effect": "SharedFs"}
    split = {"kind": "context", "operation": "unshare", "path": None, "effect": "SplitFs", "line": 2, "end_line": 6}
    move = CHILD | {"kind": "cwd", "operation": "chdir", "path": "/n", "line": 3, "end_line": 3}
    after = {"line": 7, "end_line": 7}
    assert flags(shared, split, move, after, CHILD | after) == [False, True, True, True, True]
    got = machine(shared, split | {"end_line": 2}, move, after, CHILD | after)
    assert [g[0] for g in got] == ["/w", "/w", "/w", "/w", "/n"] and not any(g[1] for g in got)


def test_namespaces_doubt_one_side_only():
    assert flags(SPAWN | {"effect": "PrivateFsNamespaceUncertain"}, {}, CHILD) == [True, False, True]
    assert flags({"kind": "context", "operation": "unshare", "path": None, "effect": "NoFsChange"}, {}) == [False, False]
    assert flags(SPAWN, CHILD, {"kind": "context", "operation": "mount", "path": None}, CHILD) == [False, False, True, True]
    assert flags(SPAWN, {"kind": "context", "operation": "chroot", "path": None}, CHILD, {}) == [False, True, False, True]


def test_quoted_text(spark):
    rows = [("a\"b\\\n\x01",)]
    got = spark.createDataFrame(rows, "s string").select(text.quoted(F.col("s")).alias("q"), text.quoted_list(F.array("s", "s")).alias("l"), text.spelled_bytes(F.encode("s", "UTF-8")).alias("b")).first()
    assert got.q == '"a\\"b\\\\\\n\\u{1}"' and got.l == f"[{got.q}, {got.q}]" and got.b == 'a"b\\x5c\\x0a\\x01'


def test_context_stays_uncertain():
    got = machine({"kind": "context", "operation": "chroot", "path": None}, {"kind": "cwd", "operation": "chdir", "path": "/n"}, {})
    assert [g[1] for g in got] == [True, True, True] and got[2][0] is None


def test_saved_runs_read_back(spark, tmp_path):
    event = {"schema_version": 2, "pid": "1", "kind": "file", "operation": "openat", "path": "/a", "outcome": "success", "evidence": {"file": "raw/trace.log", "line": 1, "end_line": 1}}
    meta = {"schema_version": 3, "id": "a1-1", "name": "one", "state": "completed"}
    store.save_run(str(tmp_path), "a1-1", meta, [json.dumps(event)])
    store.save_run(str(tmp_path), "a2-2", meta | {"id": "a2-2"}, [json.dumps(event)])
    with open(tmp_path / "runs/a2-2/events.jsonl", "a") as out:
        out.write("{}\n")
    got = [tuple(r) for r in trace.catalogue(spark, str(tmp_path)).select("run_id", "storage").collect()]
    assert got == [("a1-1", "verified"), ("a2-2", "corrupt")]
    assert trace.events(spark, str(tmp_path)).where("run_id = 'a1-1'").first().event.path == "/a"
