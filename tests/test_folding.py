"""Folding of generated files: identities by birth, both rules, the disjoint view."""

from runlens.operators import folding

SCHEMA = "pair_id long, side string, run_id string, event_index long, line long, end_line long, pid string, kind string, operation string, path string, outcome string, child_pid string, flags array<string>"


def run(side, pid, paths, flags=("O_CREAT", "O_TRUNC")):
    """A shell that spawns a compiler, which writes the paths."""
    child = str(int(pid) + 1)
    steps = [(pid, "exec", "execve", "/bin/sh", None), (pid, "spawn", "fork", child, child), (child, "spawn", "fork", child + "0", child + "0"), (child, "exec", "execve", "/bin/cc", None)]
    steps += [(child, "file", "openat", p, None) for p in paths] + [(child + "0", "file", "openat", "/common", None)]
    return [(0, side, side, i, i + 1, i + 1, p, kind, op, path, "success", born, list(flags) if kind == "file" else None) for i, (p, kind, op, path, born) in enumerate(steps)]


def frame(spark, left, right):
    return spark.createDataFrame(run("left", "10", left) + run("right", "70", right), SCHEMA)


def test_programs_are_inherited(spark):
    df = frame(spark, ["/o/a"], ["/o/b"])
    got = {(r.side, r.path): (r.actor, r.parent, r.parent_pid) for r in folding.actors(df).collect()}
    assert got[("left", "/o/a")] == ("/bin/cc", "/bin/sh", "10")
    assert got[("right", "/common")] == ("/bin/sh", "/bin/cc", "71")  # born before its parent's exec


def test_recurring_family(spark):
    df = frame(spark, ["/o/x-aaaa.o", "/o/x-bbbb.o"], ["/o/x-cccc.o", "/o/x-dddd.o"])
    rows = folding.eligible(df)
    got = folding.recurring(rows).collect()
    assert [(r.pattern, len(r.members), r.writer, r.parent) for r in got] == [("/o/x-{slot}.o", 4, "/bin/cc", "/bin/sh")]
    view = folding.candidate_view(df).collect()
    assert [(r.group_id, r.raw_index, r.n_changes) for r in view] == [("G1", 0, 4)]


def test_shared_values_are_no_family(spark):
    df = frame(spark, ["/o/x-aaaa.o", "/o/x-bbbb.o"], ["/p/x-aaaa.o", "/o/x-dddd.o"])
    assert folding.recurring(folding.eligible(df)).count() == 0


def test_paired_subtree(spark):
    files = ["a", "b", "c/d"]
    df = frame(spark, [f"/b/tmp1111/{f}" for f in files], [f"/b/tmp2222/{f}" for f in files] + ["/b/tmp2222/new"])
    got = folding.candidate_groups(df).collect()
    assert [(r.rule, r.pattern, len(r.members)) for r in got] == [(folding.SUBTREE, "/b/{slot}", 6)]
    assert sorted(r.n_changes for r in folding.candidate_view(df).collect()) == [1, 6]


def test_files_without_a_new_write_stay(spark):
    left, right = run("left", "10", ["/o/x-aaaa.o"], ["O_RDONLY"]), run("right", "70", [], ["O_RDONLY"])
    assert folding.eligible(spark.createDataFrame(left + right, SCHEMA)).count() == 0


def test_details_name_every_event_of_a_group(spark):
    df = frame(spark, ["/o/x-aaaa.o", "/o/x-bbbb.o"], ["/o/x-cccc.o", "/o/x-dddd.o"])
    got = folding.group_details(df).collect()
    assert sorted((r.group_id, r.side, r.path, r.actor, r.parent) for r in got) == [("G1", s, f"/o/x-{v}.o", "/bin/cc", "/bin/sh") for s, v in (("left", "aaaa"), ("left", "bbbb"), ("right", "cccc"), ("right", "dddd"))]
