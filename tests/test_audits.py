"""Replay of saved generations by hand, details of groups, counts of warnings."""

import pytest

from runlens.functions.vocab import REPLAY_ERRORS as SAYS
from runlens.operators import audits
from runlens.operators.provenance import provenance_errors
from runlens.sources.trace import PROVENANCE

EVENTS = """pair_id long, run_id string, event_index long, line long, end_line long, pid string, kind string, outcome string, child_pid string,
task_generation long, child_generation long, context_uncertain boolean, file string"""
#: Root 1 runs a program, introduces 2, which leaves and comes back unintroduced; then 1 leaves.
STEPS = [("1", "exec", None, 1, None, False), ("1", "spawn", "2", 1, 1, False), ("2", "exit", None, 1, None, False), ("2", "file", None, 2, None, True), ("2", "exit", None, 2, None, True), ("1", "exit", None, 1, None, False)]
RUN = "run_id string, completeness string, warnings array<string>, target_exit_raw string"


def reference(i, line=None):
    return (i, ("raw/trace.log", line or i + 1, i + 1))


def judged(spark, steps=STEPS, root=("1", 1), at=(0, 5), raw="exited with 0", done="partial", warnings=("w",), absent=False, line=None):
    rows = [(0, "r", i, i + 1, i + 1, p, kind, "exited with 0" if kind == "exit" else "success", child, g, cg, doubt, "raw/trace.log") for i, (p, kind, child, g, cg, doubt) in enumerate(steps)]
    provenance = None if absent else (1, "s", "i", root, reference(at[0], line), reference(at[1]))
    schema = spark.createDataFrame([], RUN).schema.add("target_provenance", PROVENANCE)
    runs = spark.createDataFrame([("r", done, list(warnings), raw, provenance)], schema)
    return provenance_errors(runs, spark.createDataFrame(rows, EVENTS)).first()


def swapped(i, **changes):
    names = ("pid", "kind", "child", "g", "cg", "doubt")
    return [tuple(changes.get(n, v) for n, v in zip(names, s)) if j == i else s for j, s in enumerate(STEPS)]


@pytest.mark.parametrize("given, error", [
    ({}, None),
    ({"steps": swapped(3, g=1)}, SAYS["rows"][0]),
    ({"steps": swapped(3, g=None)}, SAYS["rows"][0]),
    ({"steps": swapped(3, doubt=False)}, SAYS["rows"][1]),
    ({"steps": swapped(1, cg=2)}, SAYS["rows"][2]),
    ({"steps": [*STEPS[:2], ("1", "spawn", "2", 1, 2, False), *STEPS[3:]]}, SAYS["rows"][3]),
    ({"steps": [*STEPS[:4], STEPS[5]], "at": (0, 4), "warnings": ()}, SAYS["open"]),
    ({"done": "complete_for_supported_events"}, SAYS["doubtful"]),
    ({"absent": True}, SAYS["absent"]),
    ({"at": (0, 9)}, SAYS["bounds"]),
    ({"line": 7}, SAYS["coordinates"]),
    ({"root": ("1", 2)}, SAYS["lifetime"]),
    ({"at": (1, 5)}, SAYS["root"]),
    ({"raw": "exited with 1"}, SAYS["exit"]),
])
def test_replay(spark, given, error):
    assert judged(spark, **given).error == error


def test_the_first_contradiction_wins(spark):
    steps = [s if i not in (1, 3) else (*s[:3], s[3] + 5, *s[4:]) for i, s in enumerate(STEPS)]
    row = judged(spark, steps)
    assert (row.error, row.event_index) == (SAYS["rows"][0], 1)


def test_warnings_by_category(spark):
    told = spark.createDataFrame([("a", "raw/trace.log:3: path context unresolved; x"), ("a", "raw/trace.log:4: fs.context: y"), ("a", "raw/trace.log:4: fs.context: z"), ("b", None)], "run_id string, text string")
    assert {(r.run_id, r.category): r.n for r in audits.warning_counts(told).collect()} == {("a", "cwd.path_unresolved"): 1, ("a", "fs.context"): 2, ("b", "unclassified"): 1}
    wanted = spark.createDataFrame([("a", "cwd.path_unresolved", 1), ("a", "fs.context", 1), ("c", "fs.context", 1)], "run_id string, category string, n long")
    assert {(r.run_id, r.category): r.surplus for r in audits.warning_faults(told, wanted).collect()} == {("a", "fs.context"): 1, ("b", "unclassified"): 1, ("c", "fs.context"): -1}
