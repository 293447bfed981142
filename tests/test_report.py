"""Record contracts and whole reports on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators import evidence, records, report
from runlens.operators.contracts import first_failure
from runlens.sources.trace import METADATA

RECEIPT = T.StructType([T.StructField("status", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("logical_lines", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("reason", T.StringType())])
MANIFEST = T.StructType([T.StructField("schema_version", T.IntegerType()), T.StructField("run_id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("receipt", RECEIPT)])
TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType()}


def struct(**types):
    return T.StructType([T.StructField(n, TYPES[t]) for t, names in types.items() for n in names.split()])


SIDE = struct(long="pair_id n_events max_line", int="unsupported_schema", string="side storage storage_detail raw raw_detail load_error load_kind shape_error", boolean="has_non_v2 has_non_v3 has_v3 bad_order any_uncertain argv_missing incomplete")
SCHEMA = T.StructType([*SIDE.fields, T.StructField("manifest", MANIFEST), *METADATA.fields])
GOOD = {
    "schema_version": 3, "tool_version": "1", "id": "f17-31", "name": "a", "command": ["make"], "cwd": "/w", "started": 1, "ended": 2, "backend": "b", "state": "completed",
    "exit_code": 0, "warnings": [], "parsed_events": 1, "raw_lines": 1, "environment": {}, "completeness": "complete_for_supported_events", "collector_exit_code": 0,
    "target_exit_raw": "+++ exited with 0 +++", "pair_id": 0, "side": "left", "storage": "verified", "storage_detail": "ok", "n_events": 1, "has_non_v2": False, "has_non_v3": True,
    "has_v3": False, "bad_order": False, "max_line": 1, "any_uncertain": False, "argv_missing": False, "incomplete": False,
}


def sides(spark, *changes):
    return spark.createDataFrame([{f.name: (GOOD | x).get(f.name) for f in SCHEMA.fields} for x in changes], SCHEMA)


PROOF = {"schema_version": 1, "selection_rule": "first_successful_exec_evidence_order_v1", "identity_contract": "task_generations_evidence_order_v1", "root": {"pid": "7", "generation": 1}}
PLACE = lambda i: {"index": i, "evidence": {"file": "raw/trace.log", "line": i + 1, "end_line": i + 1}}
NEW = {"schema_version": 4, "evidence_contract": "trace-v1", "parsed_events": 2, "raw_lines": 2, "n_events": 2, "max_line": 2, "has_non_v2": True, "has_non_v3": False, "has_v3": True, "raw": "verified", "target_provenance": PROOF | {"root_exec": PLACE(0), "target_exit": PLACE(1)}, "manifest": {"schema_version": 1, "run_id": "f17-31", "file": "raw/trace.log", "receipt": {"status": "parsed", "bytes": 9, "logical_lines": 2, "sha256": "a" * 64}}}

CASES = [
    ({}, None),
    (NEW, None),
    ({"exit_code": 1}, "completed metadata lacks a confirmed target outcome"),
    ({"exit_code": 256}, "current exit code must be in 0..=255"),
    ({"signal": 3}, "target exit code and signal are mutually exclusive"),
    ({"id": "../x"}, "ID is not one safe generated component"),
    ({"id": "ab-0"}, "ID is not one safe generated component"),
    ({"name": "a\tb"}, "name must be nonempty without control characters"),
    ({"environment": None}, "metadata: missing environment or completeness"),
    ({"environment": {"A=": None}}, "environment keys must be nonempty without '=' or control characters"),
    ({"state": "odd"}, "unknown capture state"),
    ({"completeness": "partial"}, "partial metadata records no evidence limitation"),
    ({"warnings": ["w"]}, "complete metadata cannot contain capture limitations"),
    ({"state": "running", "completeness": "pending"}, "running metadata contains finalized capture facts"),
    ({"state": "interrupted"}, "failed or interrupted capture must be incomplete"),
    ({"has_non_v2": True}, "current metadata schema requires only event schema 2"),
    ({"parsed_events": 2}, "metadata parsed event count does not match events"),
    ({"max_line": 9}, "event evidence lines fall outside the recorded raw trace"),
    ({"any_uncertain": True}, "complete metadata contains context-uncertain evidence"),
    ({"shape_error": "x", "any_uncertain": True}, "current event shape: x"),
    ({"storage": "corrupt"}, "failed or unknown storage integrity cannot be a loaded comparison input"),
    ({"schema_version": 7}, "unsupported metadata or event schema in comparison input"),
    ({"raw": "verified"}, "historical record cannot claim new raw integrity"),
    (NEW | {"raw": None}, "trace-v1 run lacks independent raw integrity"),
    (NEW | {"exit_code": 3, "collector_exit_code": 3}, "trace-v1 numeric target outcome contradicts its saved exit spelling"),
    (NEW | {"target_provenance": PROOF | {"root_exec": PLACE(1), "target_exit": PLACE(0)}}, "target exit must follow a distinct selected exec reference"),
    (NEW | {"target_provenance": PROOF | {"root_exec": PLACE(0), "target_exit": PLACE(5)}}, "target provenance references exceed saved event or evidence bounds"),
    (NEW | {"manifest": NEW["manifest"] | {"run_id": "b"}}, "raw manifest identity or metadata tuple mismatch"),
    (NEW | {"manifest": None}, "raw component facts contradict structured finalization or receipt"),
    ({"schema_version": 2, "id": "free form", "storage": "unverified", "state": "whatever"}, None),
]


def test_comparison_contract(spark):
    df = sides(spark, *({**case, "pair_id": i} for i, (case, _) in enumerate(CASES)))
    got = {r.pair_id: r.e for r in df.select("pair_id", records.comparison_error().alias("e")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


EVENT = {"run_id": "r", "event_index": 0, "schema_version": 2, "pid": "1", "kind": "file", "operation": "openat", "path": "/a", "outcome": "success", "file": "raw/trace.log", "line": 1, "end_line": 1, "argv": None, "child_pid": None, "context_uncertain": False, "task_generation": None, "child_generation": None}
EVENT_SCHEMA = "run_id string, event_index long, schema_version int, pid string, kind string, operation string, path string, outcome string, file string, line long, end_line long, argv array<string>, child_pid string, context_uncertain boolean, task_generation long, child_generation long"


@pytest.mark.parametrize(("change", "want"), [
    ({}, None), ({"pid": "0"}, "positive numeric task ID"), ({"kind": "exec"}, "contradicts its current family"), ({"path": "a"}, "explicit relative context"),
    ({"path": "relative:a [x]", "context_uncertain": True}, None), ({"path": ""}, "nonempty observed path"), ({"end_line": 0}, "ordered raw/trace.log"),
    ({"argv": []}, "only exec events"), ({"task_generation": 1}, "event2 cannot claim"), ({"schema_version": 3}, "event3 requires positive"),
    ({"kind": "spawn", "operation": "fork", "path": "2", "child_pid": "2"}, None), ({"kind": "spawn", "operation": "fork", "path": "3", "child_pid": "2"}, "same positive child"),
    ({"kind": "cwd", "operation": "chdir", "path": None, "context_uncertain": True}, None),
    ({"schema_version": 3, "task_generation": 1, "kind": "exit", "operation": "exit", "path": None, "outcome": "exited with 0"}, "completion framing"),
])
def test_event_contract(spark, change, want):
    got = spark.createDataFrame([EVENT | change], EVENT_SCHEMA).select(first_failure(records.event_rules()).alias("e")).first().e
    assert got is None if want is None else want in got


def events(spark, *changes):
    base = {"pair_id": 0, "side": "left", "event_index": 0, "line": 1, "end_line": 1, "kind": "file", "operation": "openat", "path": "/srv/rates.csv", "outcome": "success"}
    return spark.createDataFrame([base | x for x in changes], "pair_id long, side string, event_index long, line long, end_line long, kind string, operation string, path string, outcome string")


def lines(done, found):
    return [r.line for r in report.text(done, found).orderBy("pair_id", "line_no").collect()]


def test_report_of_a_changed_outcome(spark):
    both = sides(spark, {"name": "nightly-one"}, {"side": "right", "name": "nightly-two", "id": "f18-32"})
    done, found = report.report(both, events(spark, {}, {"side": "right", "outcome": "ENOENT"}))
    want = """Run comparison: nightly-one → nightly-two
Observed differences: yes
Capture completeness: left=complete, right=complete
Storage integrity: left=verified, right=verified
Exit code: 1

File access outcome changes
  /srv/rates.csv (openat)
  success → ENOENT
  evidence: runs/f17-31/raw/trace.log:1-1
  evidence: runs/f18-32/raw/trace.log:1-1

Total observed changes: 1 (including folded details)

Observed changes are investigation clues, not proof of a root cause."""
    assert lines(done, found) == want.split("\n")
    document = json.loads(report.json(done, found).first().value)
    assert list(document) == ["schema_version", "observed_differences", "reliability", "exit_code", "errors", "left", "right", "left_id", "right_id", "changes", "warnings"]
    assert document["changes"][0]["detail_group"] is None and document["changes"][0]["right_evidence"] == [{"file": "raw/trace.log", "line": 1, "end_line": 1}]
    assert document["reliability"]["left"] == {"capture": "complete", "storage": "verified"}


def test_metadata_changes_rank_before_observations(spark):
    other = {"side": "right", "exit_code": 2, "collector_exit_code": 2, "target_exit_raw": "+++ exited with 2 +++", "cwd": "/v", "command": ["make", 'a"'], "environment": {"B": None}, "completeness": "partial", "warnings": ["w"]}
    done, found = report.report(sides(spark, {}, other), events(spark, {}))
    got = [(r.change, r.subject, r.left, r.right) for r in found.orderBy("position").collect()]
    assert [g[0] for g in got] == ["ExitStatus", "CaptureCompleteness", "InitialWorkingDirectory", "CommandArguments", "SelectedStartupEnvironment", "RemovedFileAccess"]
    assert got[0][2:] == (["code=Some(0), signal=None"], ["code=Some(2), signal=None"]) and got[3][3] == ['["make", "a\\""]']
    assert got[4][1:] == ("B", ["(not selected/unknown)"], ["(unset)"])
    row = done.first()
    assert row.exit_code == 3 and row.report_warnings == ["a: state=completed, 1 parser warnings; inspect metadata.json"]
    assert "RELIABILITY NOT ESTABLISHED" in "\n".join(lines(done, found))


def test_failed_sides_give_status_two(spark):
    both = sides(spark, {}, {"side": "right", "load_error": "metadata.json: damaged", "load_kind": "Corrupt"}, {"pair_id": 1}, {"pair_id": 1, "side": "right"})
    done, found = report.report(both, events(spark, {}, {"pair_id": 1}, {"pair_id": 1, "side": "right"}))
    rows = {r.pair_id: r for r in done.collect()}
    assert (rows[0].exit_code, rows[0].errors, rows[0].observed) == (2, ["right: metadata.json: damaged"], None)
    assert rows[0].right_quality.storage == "corrupt" and (rows[1].exit_code, rows[1].observed) == (0, False)
    assert found.count() == 0 and "Observed differences: not evaluated" in lines(done.where("pair_id = 0"), found)


def test_new_format_adds_raw_and_provenance(spark):
    right = NEW | {"side": "right", "id": "f18-32", "manifest": NEW["manifest"] | {"run_id": "f18-32"}, "exit_code": 1, "collector_exit_code": 1, "target_exit_raw": "+++ exited with 1 +++"}
    done, found = report.report(sides(spark, NEW, right), events(spark))
    row, change = done.first(), found.first()
    assert (row.format, row.exit_code, row.left_quality.raw, row.left_quality.provenance) == (5, 1, "verified", "verified")
    assert change.left_evidence[0].line == 2 and "target_provenance" in json.loads(report.json(done, found).first().value)
    mixed, _ = report.report(sides(spark, {}, right), events(spark))
    assert mixed.first().exit_code == 3 and mixed.first().report_warnings[0].startswith("a: trace-v1 raw/provenance")


def test_folding_starts_after_the_first_five(spark):
    rows = [{"path": f"/p/{i}", "outcome": "ENOENT", "event_index": i} for i in range(9)]
    done, found = report.report(sides(spark, {}, {"side": "right"}), events(spark, *rows))
    got = lines(done, found)
    assert sum(x.startswith("Removed") for x in got) == 5 and [x for x in got if "folded;" in x][0].startswith("  4 changes folded;") and "[6, 7, 8]" in "\n".join(got)


def test_list_lines(spark):
    rows = [("d1", "i", "n", None, "verified", "ok", "verified", "fine"), ("d2", None, None, None, "corrupt", "bad", None, None)]
    df = spark.createDataFrame(rows, "directory string, id string, name string, completeness string, storage string, storage_detail string, raw string, raw_detail string")
    assert [r.line for r in report.list_lines(df).orderBy("directory").collect()] == ["i\tn\td1\tcapture=unknown\tstorage=verified\tok\traw=verified\tfine", "(no safe ID)\t(unknown label)\td2\tcapture=unknown\tstorage=corrupt\tbad"]


def test_run_facts(spark):
    got = records.run_facts(spark.createDataFrame([EVENT, EVENT | {"event_index": 1, "path": "x", "line": 4, "end_line": 5}], EVENT_SCHEMA)).first()
    assert (got.n_events, got.max_line, got.incomplete, got.has_non_v2) == (2, 5, True, False) and "relative" in got.shape_error


def test_show_lines(spark):
    run = sides(spark, {"environment": {"B": None, "A": "1"}, "completeness": "partial", "warnings": ["w"]}).withColumn("run_id", F.lit("r"))
    event = EVENT | {"cwd_before": "/w"}
    seen = spark.createDataFrame([event, event | {"event_index": 1, "kind": "exec", "operation": "execve", "argv": ["make", "x y"], "path": "relative:m [cwd unresolved]", "cwd_before": None}], EVENT_SCHEMA + ", cwd_before string")
    got = [r.line for r in report.show_lines(run, seen).orderBy("line_no").collect()]
    assert got[:8] == ["Storage integrity: verified — ok", "a (f17-31)", "State: completed / partial", 'Command: ["make"]', "Initial cwd: /w", "Exit: Some(0); signal: None", "Events: 2", "env A: 1"]
    assert got[8] == "env B: (unset)" and got[9].startswith("Path semantics: ")
    assert got[10:13] == ["  Last observed CWD (context only, not a current physical path): /w", "  Path context: recorded absolute spelling; verify syscall evidence", "1 openat /a => success [runs/f17-31/raw/trace.log:1-1]"]
    assert got[13].endswith("unknown") and got[14].endswith("uncertain / relative observation") and got[16:] == ['exec arguments (PID 1): ["make", "x y"]', "warning: w"]


def test_recorded_lines(spark):
    df = spark.createDataFrame([("a1-1", 'n"', "completed", 3, ["w"], "/e")], "run_id string, name string, state string, event_count long, warnings array<string>, evidence_dir string")
    assert [r.line for r in report.recorded_lines(df).orderBy("at").collect()] == ['Recorded "n\\"": a1-1 (completed, 3 events, 1 warnings)', "Evidence: /e", "warning: w"]


def test_format_6_maps_changes_to_their_events(spark):
    rows = [{}, *({"event_index": i, "line": i + 1, "end_line": i + 1, "side": "right", "outcome": o} for i, o in enumerate(["ENOENT"] * 4 + ["EPERM"]))]
    df = events(spark, *rows)
    done, found = report.report(sides(spark, {}, {"side": "right", "id": "f18-32", "cwd": "/v"}), df, 6)
    mapped = evidence.evidence_mappings(done, found, df)
    changes = {x["category"]: x["evidence_mapping"] for x in json.loads(report.json(done, found, mapped).first().value)["changes"]}
    cwd, file = changes["Initial working directory"], changes["File access outcome changes"]
    assert cwd["observation"] is None and cwd["left"] == {"source": "metadata", "metadata_fields": ["metadata.cwd"], "event_count": None, "sample_event_indices": [], "sample_count": 0, "omitted_sample_count": None, "outcomes": []}
    right = file["right"]
    assert (file["observation"]["path"], right["source"], right["event_count"], right["sample_count"], right["omitted_sample_count"]) == ("/srv/rates.csv", "normalized_events", 5, 3, 2)
    assert [(o["outcome"], o["event_count"], [e["index"] for e in o["events"]]) for o in right["outcomes"]] == [("ENOENT", 4, [0, 1, 2, 3]), ("EPERM", 1, [4])]
    assert sorted(right["sample_event_indices"]) == [0, 1, 4]
    got = [r.line for r in report.text(done, found, mapped).orderBy("line_no").collect()]
    assert "  left evidence: source=metadata, events=N/A, sampled=0, omitted_from_sample=N/A" in got and "    metadata fields: metadata.cwd" in got
    assert "  right evidence: source=normalized_events, events=5, sampled=3, omitted_from_sample=2" in got and "    outcome EPERM: 1 events (all references in --json)" in got


def test_format_6_withheld_sides_and_proven_exits(spark):
    right = NEW | {"side": "right", "id": "f18-32", "manifest": NEW["manifest"] | {"run_id": "f18-32"}, "exit_code": 1, "collector_exit_code": 1, "target_exit_raw": "+++ exited with 1 +++"}
    df = events(spark)
    done, found = report.report(sides(spark, NEW, right), df, 6)
    row = evidence.evidence_mappings(done, found, df).first().evidence_mapping
    assert (row.left.source, row.left.sample_event_indices, row.right.outcomes[0].events[0]["index"], row.right.omitted_sample_count) == ("target_provenance", [1], 1, 0)
    waiting = {"storage": "unfinalized", "state": "running", "completeness": "pending", "ended": None, "exit_code": None, "collector_exit_code": None, "target_exit_raw": None, "parsed_events": 0, "raw_lines": 0, "n_events": 0, "has_non_v3": None, "max_line": None}
    df = events(spark, {"side": "right"})
    done, found = report.report(sides(spark, waiting, {"side": "right", "id": "f18-32"}), df, 6)
    got = {r.change: r.evidence_mapping for r in evidence.evidence_mappings(done, found, df).join(found.select("position", "change"), "position").collect()}
    assert {m.left.source for m in got.values()} == {"withheld"} and got["NewFileAccess"].left.event_count is None and got["NewFileAccess"].right.event_count == 1
