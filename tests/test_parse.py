"""Raw logs to events and warnings, stores with damage, and the load decision."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import decode
from runlens.operators import compare, parse
from runlens.sources import store, trace

LOG = r"""7 execve("\x2f\x62\x69\x6e\x2f\x73\x68", ["\x73\x68", "-c"], 0x0 /* 0 vars */) = 0
7 openat(AT_FDCWD, "\x2f\x61", O_RDONLY) = -1 EACCES (Permission denied)
8 access("\x2f\x62", R_OK <unfinished ...>
8 <... access resumed>) = 0
7 open("\x2f\x22\xff", O_RDONLY) = 3
7 +++ exited with 1 +++
9 chdir("\x2f" <unfinished ...>
torn
"""


def lines_of(spark, raw, run_id="r"):
    rows = [(run_id, i + 1, x, True) for i, x in enumerate(raw.splitlines())]
    return spark.createDataFrame(rows, "run_id string, line long, text string, terminated boolean")


def parsed(spark, raw):
    got = parse.parse(lines_of(spark, raw), "/w")
    return got.events.orderBy("event_index").collect(), [r.text.split(": ", 1)[1] for r in got.warnings.orderBy("phase", "place", "step").collect()]


def test_a_small_log(spark):
    events, warnings = parsed(spark, LOG)
    assert [(e.pid, e.kind, e.path, e.outcome, e.line, e.end_line) for e in events] == [
        ("7", "exec", "/bin/sh", "success", 1, 1), ("7", "file", "/a", "EACCES", 2, 2), ("8", "file", "/b", "success", 3, 4), ("7", "file", r'/"\xff', "success", 5, 5), ("7", "exit", None, "+++ exited with 1 +++", 6, 6),
    ]
    assert events[0].argv == ["sh", "-c"] and events[0].cwd_before == "/w" and [e.context_uncertain for e in events] == [False, False, True, False, False]
    assert warnings == ["malformed line", "unfinished call at end of trace", "task.identity: Unintroduced: task 8 appeared without a successful spawn; generation identity is incomplete"]


def test_lines_that_are_no_events(spark):
    events, warnings = parsed(spark, '1 +++ exited with 256 +++\nx y\n1 read(3) = 0\n1 open("a"..., 0) = 3\n1 --- SIGCHLD ---\n1 +++ killed by SIGODD_+- (core dumped) +++\n1 open("/a") = 3\n')
    assert [e.kind for e in events] == ["exit", "file"]
    assert warnings[:5] == ["unrecognized process status: +++ exited with 256 +++", "invalid process identifier", "unsupported or incomplete event: read(3) = 0", "abbreviated trace data; inspect raw evidence", 'unsupported or incomplete event: open("a"..., 0) = 3']
    assert warnings[5].startswith("task.identity: Reappeared: task 1#2 appeared after 1#1 exited at raw/trace.log:6 ")
    events, warnings = parsed(spark, "")
    assert events == [] and warnings == []


def test_spawns_and_open_calls(spark):
    raw = '1 fork() = 2\n2 open("/a" <unfinished ...>\n2 open("/b" <unfinished ...>\n3 open("/c" <unfinished ...>\n1 fork() = 3\n3 <... open resumed>) = 3\n2 <... access resumed>) = 0\n2 open("/d" <unfinished ...>\n2 +++ exited with 0 +++\n'
    events, warnings = parsed(spark, raw)
    assert [(e.kind, e.child_pid) for e in events] == [("spawn", "2"), ("spawn", "3"), ("exit", None)]
    assert warnings[:5] == ["replaced unfinished call", "task 3 unfinished call from line 4 predates spawn entry at line 5; consult raw evidence", "unmatched resumed call", "resumed syscall does not match line 3", "unfinished call from line 8 ended with task 2 exit; consult raw evidence"]


def test_coverage_counts_no_call_that_a_spawn_broke(spark):
    lines = lines_of(spark, '8 access("\\x2f\\x61", R_OK <unfinished ...>\n9 fork() = 8\n8 <... access resumed>) = 0\n9 read(3) = 0\n')
    got = parse.coverage(lines, parse.observations(lines).events).first()
    assert (got.n_calls, got.n_events, got.n_missing, got.n_extra) == (2, 1, 1, 0)


@pytest.mark.parametrize(
    ("call", "path"),
    [
        (r'openat(3<\x2f\x64>, "x", 0) = -1 ENOENT (no)', "/d/x"),
        (r'openat(3<\x2f\x2f>, "x", 0) = -1 ENOENT (no)', "//x"),
        (r'openat(3<\x2f>, "", 0) = 4', r"relative: [dirfd:\x2f]"),
        (r'openat(3</d (deleted)>, "x", 0) = 4', "relative:x [dirfd:/d (deleted)]"),
        (r'openat(3<\x2f\x64> (deleted), "x", 0) = 4', "relative:x [dirfd annotation incomplete]"),
        (r'openat(3, "x", 0) = 4', "relative:x [dirfd unresolved]"),
        (r'openat(AT_FDCWD, "x", 0) = 4', "relative:x [cwd unresolved]"),
        (r'openat(AT_FDCWD, "x", 0) = 4<\x2f\x72>', "/r"),
        (r'access("x", 0) = 0', "relative:x [cwd unresolved]"),
        (r'fchdir(3<\x2f\xfe>) = 0', r"/\xfe"),
        (r"fchdir(3) = 0", None),
    ],
)
def test_paths(spark, call, path):
    got = parse.observations(lines_of(spark, f"1 {call}\n")).events.first()
    assert got is not None and got.path == path


def test_split_call():
    assert decode.split_call(r'open("a\"),", {x=[1, 2]}, f(3)) = 3<a> (ok)') == ([r'"a\"),"', "{x=[1, 2]}", "f(3)"], "3<a> (ok)", None)
    assert decode.split_call("fork() = 3") == ([""], "3", None)
    for broken in (None, "", "fork", "fork(", 'open("a) = 3', "open(a) 3"):
        assert decode.split_call(broken) == (None, None, None)


def saved(tmp_path, name, run_id, data):
    path = tmp_path / "runs" / run_id / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_refused_files_keep_a_row(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    assert trace.documents(spark, root, "raw/trace.log").count() == 0 and trace.catalogue(spark, root).count() == 0
    saved(tmp_path, "raw/trace.log", "a1-1", b"1 open(\"/a\") = 3\n")
    saved(tmp_path, "raw/trace.log", "a2-2", b"x" * 5000)
    saved(tmp_path, "raw/trace.log", "a3-3", b"1 open(\"\xff\") = 3\n")
    monkeypatch.setattr(trace, "MAX_WHOLE", 4096)
    got = {r.run_id: (r.error, r.bytes) for r in trace.refused(trace.documents(spark, root, "raw/trace.log")).collect()}
    assert got == {"a2-2": ("resource limit of 4096 bytes", 5000), "a3-3": ("not UTF-8", 16)}
    events, warnings = trace.parsed(spark, root)
    assert [r.run_id for r in events.collect()] == ["a1-1"]
    assert {r.run_id: r.text for r in warnings.where("phase = -1").collect()} == {"a2-2": "raw/trace.log: resource limit of 4096 bytes", "a3-3": "raw/trace.log: not UTF-8"}
    assert trace.raw_observations(spark, root).where("error is not null and line is null").count() == 2
    monkeypatch.setattr(trace, "MAX_LINE", 8)
    assert [(r.line, r.text, r.error) for r in trace.lines(trace.documents(spark, root, "raw/trace.log")).where("run_id = 'a1-1'").collect()] == [(1, None, "resource limit of 8 bytes")]


def test_catalogue_keeps_every_folder(spark, tmp_path):
    root, event = str(tmp_path), {"schema_version": 2, "pid": "1", "kind": "file", "operation": "open", "path": "/a", "outcome": "success"}
    (tmp_path / "runs" / "a0-0").mkdir(parents=True)
    assert [tuple(r)[0::4] for r in trace.catalogue(spark, root).select("run_id", "name", "state", "completeness", "storage").collect()] == [("a0-0", "corrupt")]
    meta = lambda i: {"schema_version": 3, "id": i, "name": "n", "state": "completed", "parsed_events": 1}
    store.save_run(root, "a1-1", meta("a1-1"), [json.dumps(event)])
    saved(tmp_path, "metadata.json", "a2-2", json.dumps(meta("a2-2")).encode())
    saved(tmp_path, "metadata.json", "a3-3", json.dumps({"x": [0] * 70_000}).encode())
    rows = trace.loaded(trace.files(spark, root))
    assert {r.run_id: r.storage for r in rows.collect()} == {"a0-0": "corrupt", "a1-1": "verified", "a2-2": "unfinalized", "a3-3": "unavailable"}
    shown = {r.run_id: json.loads(r.json) for r in trace.list_json(rows).collect()}
    assert list(shown["a1-1"]) == sorted(shown["a1-1"]) and shown["a1-1"]["storage_integrity"]["status"] == "verified" and shown["a1-1"]["environment"] is None
    assert shown["a0-0"] == {"directory": "a0-0", "id": "a0-0", "name": None, "storage_integrity": {"status": "corrupt", "detail": "metadata.json: missing"}}
    one = json.loads(trace.show_json(spark, root, "a1-1"))
    assert one["metadata"]["id"] == "a1-1" and [e["path"] for e in one["events"]] == ["/a"] and one["storage_integrity"]["status"] == "verified"


def test_receipts_are_compared_with_the_raw_log(spark, tmp_path):
    log, root = b"1 open(\"/a\") = 3\n", str(tmp_path)
    check = lambda data: {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    for run_id, on_disk in (("a1-1", log), ("a2-2", log.replace(b"/a", b"/b")), ("a3-3", log + log), ("a4-4", None)):
        files = {
            "metadata.json": {"schema_version": 4, "id": run_id, "name": "n", "state": "completed", "parsed_events": 0, "raw_lines": 1},
            "raw-integrity.json": {"schema_version": 1, "run_id": run_id, "file": "raw/trace.log", "receipt": {"status": "parsed", "logical_lines": 1} | check(log)},
        }
        data = {k: json.dumps(v).encode() for k, v in files.items()} | {"events.jsonl": b""}
        marker = {"schema_version": 2, "run_id": run_id, "event_count": 0, "events": check(b""), "metadata": check(data["metadata.json"]), "raw_manifest": check(data["raw-integrity.json"])}
        for name, content in (data | {"finalized.json": json.dumps(marker).encode()}).items():
            saved(tmp_path, name, run_id, content)
        if on_disk is not None:
            saved(tmp_path, "raw/trace.log", run_id, on_disk)
    got = {r.run_id: (r.storage, r.raw_status) for r in trace.loaded(trace.files(spark, root)).collect()}
    assert got == {"a1-1": ("verified", "verified"), "a2-2": ("verified", "corrupt"), "a3-3": ("verified", "corrupt"), "a4-4": ("verified", "corrupt")}


def test_samples_match_a_plain_ranking(spark):
    rng = random.Random(3)
    rows = [(1, rng.choice(["left", "right"]), i, rng.randint(1, 6), "file", "open", rng.choice(["/a", "/b"]), rng.choice(["success", "ENOENT", "EACCES"])) for i in range(200)]
    rows += [(2, "left", i, 1, "file", "open", "/c", "success") for i in range(50)] + [(2, "right", 99, 1, "file", "open", "/c", "ENOENT")]
    frame = spark.createDataFrame(rows, "pair_id int, side string, event_index long, line long, kind string, operation string, path string, outcome string").withColumn("end_line", F.col("line"))
    want = set()
    for pair, path in {(r[0], r[6]) for r in rows}:
        sets = {s: {r[7] for r in rows if (r[0], r[6], r[1]) == (pair, path, s)} for s in ("left", "right")}
        if sets["left"] == sets["right"]:
            continue
        for side, other in (("left", "right"), ("right", "left")):
            mine, seen, order = sorted((r for r in rows if (r[0], r[6], r[1]) == (pair, path, side)), key=lambda r: r[2]), set(), []
            for r in mine:
                step = 2 if r[7] in sets[other] else 3 if r[7] in seen else 1
                seen.add(r[7])
                order.append((step, r[7], r[2], r[3]))
            taken, places = [], set()
            for step, outcome, index, line in sorted(order):
                if step < 3 or line not in places:
                    taken.append(index)
                places.add(line)
            want |= {(pair, path, side, k + 1, i) for k, i in enumerate(taken[:3])}
    got = {(r.pair_id, r.path, r.side, r.slot, r.event_index) for r in compare.evidence_samples(frame).collect()}
    assert got == want
