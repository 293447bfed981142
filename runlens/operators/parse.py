"""Raw trace lines to typed events and warnings.

One batch plan: lines are framed and classified by column expressions, interrupted calls
are stitched by windows per (run, task), whole calls are cut into arguments by one Arrow
UDF that looks at structural characters only, and every operand (paths, return values,
argv, flags) is decoded by column expressions. Lifetimes and working-directory contexts
come from the saved-event operators, so a parsed log and a stored run share their rules.

Defined cases: a line without a process number, a status or a call that isn't understood
gives a warning and no event; signal deliveries give neither; an empty log gives nothing.
Evidence lines are those of the log: nothing is renumbered.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import decode
from runlens.functions.text import spelled_bytes
from runlens.functions.vocab import AT_CALLS, IDENTITY_END, IDENTITY_WARNINGS, PARSE_WARNINGS, RETURNS_PATH, UNTRUSTED
from runlens.session import checkpointed, ship_package

from .context import context_state
from .lifecycle import generations, stitched, timeline

FILE = "raw/trace.log"
#: Order of warnings: those of lines, of the end of the file, of calls left open, of identities, of contexts.
LINES, NEWLINE, LEFT_OPEN, IDENTITY, CONTEXT = range(5)


class Parsed(NamedTuple):
    events: DataFrame
    warnings: DataFrame


def _said(name: str, *values: Column) -> Column:
    """A fixed warning with its places filled."""
    parts = PARSE_WARNINGS[name].split("{}")
    text = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        text += [value.cast("string"), F.lit(after)]
    return F.concat(*text)


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` (run_id, line, text) with pid, body, kind ``t`` (also Q: a status that is no exit, M and P: no line of a process), op, head and tail of halves."""
    whole = F.regexp_extract("text", r"(?s)^\s*(.*?)\s*$", 1)
    rows = lines.select("run_id", "line", whole.alias("whole")).withColumn("task", F.regexp_extract("whole", r"(?s)^(\S+)\s", 1))
    rows = rows.withColumn("body", F.regexp_extract("whole", r"(?s)^\S+\s+(.*)$", 1))
    kind = decode.line_kind(F.col("body"))
    t = F.when(F.col("task") == "", "M").when(~F.col("task").rlike("^[0-9]+$"), "P").otherwise(F.coalesce(kind, F.when(F.col("body").startswith("+++ "), "Q").otherwise("C")))
    resumed = r"(?s)^<\.\.\. (.*?) resumed>(.*)$"
    op = F.when(t == "R", F.regexp_extract("body", resumed, 1)).otherwise(F.substring_index("body", "(", 1))
    return rows.select(
        "run_id", "line", F.col("task").alias("pid"), "body", t.alias("t"), op.alias("op"),
        F.when(t == "U", F.substr("body", F.lit(1), F.length("body") - len("<unfinished ...>"))).alias("head"), F.when(t == "R", F.regexp_extract("body", resumed, 2)).alias("tail"),
    )


def calls(rows: DataFrame) -> DataFrame:
    """Whole bodies of C rows, and of R rows joined to the call their task left open."""
    w = Window.partitionBy("run_id", "pid").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("t").isin("U", "R", "X"), F.struct("t", "line", "op", "head")), ignorenulls=True).over(w)
    rows = rows.where("t in ('U', 'R', 'X', 'C')").withColumn("last", last)
    joins = (F.col("t") == "R") & F.col("last.t").eqNullSafe("U") & F.col("last.op").eqNullSafe(F.col("op"))
    rows = rows.withColumn("whole", F.when(F.col("t") == "C", F.col("body")).when(joins, F.concat("last.head", "tail")))
    return rows.where("whole is not null").select("run_id", "line", "pid", "op", "whole")


def decoded(rows: DataFrame) -> DataFrame:
    """Events of ``rows`` (op, whole, ...): kind, path, outcome, argv, child_pid, effect; kind null where the call isn't understood."""
    rows = rows.withColumn("call", decode.call_parts("whole")).withColumn("args", F.col("call.args")).withColumn("value", F.regexp_extract("call.returned", r"^(\S+)", 1))
    kind, args, op = decode.kind_of(F.col("op")), F.col("args"), F.col("op")
    outcome = decode.outcome(F.col("call.returned"))
    success = outcome == "success"
    at = op.isin(AT_CALLS)
    operand = decode.unquoted(F.get(args, F.when(at, 1).otherwise(0)))
    relative = operand.isNotNull() & (F.coalesce(F.substring(F.hex(operand), 1, 2), F.lit("")) != "2F")
    observed = F.when(op.isin(RETURNS_PATH) & success & relative, decode.annotated_path(F.col("value")))
    path = (
        F.when(kind == "spawn", F.col("value"))
        .when(op == "fchdir", decode.annotated_path(F.get(args, F.lit(0))))
        .when(kind.isin("file", "exec", "cwd"), F.coalesce(observed, decode.resolved_path(args, at)))
    )
    words = F.transform("call.argv", lambda x: spelled_bytes(decode.unquoted(x)))
    argv = F.when((kind == "exec") & F.forall(words, lambda x: x.isNotNull()), words)
    effect = F.when(~success, None).when(op.isin("fork", "vfork"), "PrivateFs").when(op == "clone", F.coalesce(decode.clone_effect(decode.field(args, "flags=")), F.lit("Unknown")))
    effect = effect.when(op == "clone3", F.coalesce(decode.clone3_effect(decode.field(args, "flags="), decode.field(args, "exit_signal=")), F.lit("Unknown"))).when(op == "unshare", decode.unshare_effect(F.get(args, F.lit(0))))
    whole = args.isNotNull() & kind.isNotNull() & (kind != "exit") & outcome.isNotNull() & (path.isNotNull() | kind.isin("context") | (op == "fchdir"))
    given = {"kind": kind, "path": path, "outcome": outcome, "argv": argv, "child_pid": F.when((kind == "spawn") & success, F.col("value")), "effect": effect}
    rows = rows.select("run_id", "line", "pid", "op", "whole", F.when(whole, F.struct(*(c.alias(n) for n, c in given.items()))).alias("e"))
    return rows.select("run_id", "line", "pid", "op", "whole", "e.*")


def _warned(rows: DataFrame, at: Column, step: int, text: Column, phase: int = LINES) -> DataFrame:
    place = F.concat(F.lit(f"{FILE}:"), at.cast("string"), F.lit(": "))
    return rows.select("run_id", F.lit(phase).alias("phase"), at.cast("long").alias("place"), F.lit(step).alias("step"), F.concat(place, text).alias("text"))


def _states(rows: DataFrame, found: DataFrame) -> DataFrame:
    """States of the calls of ``rows``; ``found`` are the decoded calls, at least those of spawns."""
    child = found.where("child_pid is not null").select("run_id", "line", F.col("child_pid").alias("child"))
    control = rows.where("t in ('U', 'R', 'X', 'C')").join(child, ["run_id", "line"], "left").select("run_id", "line", "pid", "t", "op", "child")
    return stitched(control, detail=True)


def observations(lines: DataFrame) -> Parsed:
    """Events of single calls and exits, without identities and contexts, and the warnings of lines and of the end."""
    ship_package(lines.sparkSession)
    rows = checkpointed(classified(lines))
    found = checkpointed(decoded(calls(rows)))
    states = checkpointed(_states(rows, found))
    good = states.where("state in ('complete', 'stitched')").select("run_id", F.col("end_line").alias("line"), F.col("line").alias("first"))
    kept = found.join(good, ["run_id", "line"])
    fields = ["run_id", "line", "end_line", "pid", "kind", "operation", "path", "outcome", "argv", "child_pid", "effect"]
    events = kept.where("kind is not null").select("run_id", F.col("first").alias("line"), F.col("line").alias("end_line"), "pid", "kind", F.col("op").alias("operation"), *fields[6:])
    none = lambda kind: F.lit(None).cast(kind)
    exits = rows.where("t = 'X'").select("run_id", "line", F.col("line").alias("end_line"), "pid", F.lit("exit").alias("kind"), F.lit("exit").alias("operation"), none("string").alias("path"), F.col("body").alias("outcome"), none("array<string>").alias("argv"), none("string").alias("child_pid"), none("string").alias("effect"))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("end_line"))
    events = events.union(exits).withColumn("event_index", (order - 1).cast("long"))
    line, other = F.col("line"), F.col("other")
    is_ = lambda name: states.where(F.col("state") == name)
    mismatch = is_("resumed mismatch")
    said = [
        _warned(rows.where("t = 'M'"), line, 0, _said("malformed")),
        _warned(rows.where("t = 'P'"), line, 0, _said("pid")),
        _warned(rows.where("t = 'Q'"), line, 2, _said("status", F.col("body"))),
        _warned(is_("replaced"), other, 0, _said("replaced")),
        _warned(is_("unmatched resumed").union(mismatch.where("op = ''")), F.col("end_line"), 0, _said("unmatched")),
        _warned(mismatch.where("op <> ''"), F.col("end_line"), 0, _said("mismatch", other)),
        _warned(rows.where("t in ('C', 'S', 'X', 'Q')").where(decode.abbreviated(F.col("body"))), line, 1, _said("abbreviated")),
        _warned(kept.where("first < line").where(decode.abbreviated(F.col("whole"))), line, 1, _said("abbreviated")),
        _warned(kept.where("kind is null"), line, 2, _said("event", F.col("whole"))),
        _warned(is_("ended with exit"), other, 2, _said("exit", line, F.col("pid"))),
        _warned(is_("predates spawn entry"), other, 2, _said("spawn", F.col("pid"), line, F.col("entered"))),
        _warned(is_("unfinished at end"), line, 0, _said("end"), LEFT_OPEN),
    ]
    # Calls left open come in byte order of their task, not of their line.
    open_order = F.row_number().over(Window.partitionBy("run_id").orderBy("pid"))
    left = is_("unfinished at end").withColumn("n", open_order)
    said[-1] = _warned(left, line, 0, _said("end"), LEFT_OPEN).drop("place").join(left.select("run_id", F.concat(F.lit(f"{FILE}:"), line.cast("string"), F.lit(": "), _said("end")).alias("text"), F.col("n").cast("long").alias("place")), ["run_id", "text"]).select("run_id", "phase", "place", "step", "text")
    if "terminated" in lines.columns:
        ends = lines.groupBy("run_id").agg(F.max_by("terminated", "line").alias("ended")).where("not ended")
        said.append(ends.select("run_id", F.lit(NEWLINE).alias("phase"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("step"), F.concat(F.lit(f"{FILE}: "), _said("newline")).alias("text")))
    warnings = said[0]
    for more in said[1:]:
        warnings = warnings.union(more)
    return Parsed(events, warnings)


def warned_events(events: DataFrame, warnings: DataFrame) -> DataFrame:
    """Warnings joined to the event that begins at their line, where only one does."""
    at = F.regexp_extract("text", f"^{FILE}:([0-9]+): ", 1).try_cast("bigint")
    alone = events.groupBy("run_id", "line").agg(F.count(F.lit(1)).alias("n"), F.min("end_line").alias("end_line"), F.min("event_index").alias("event_index")).where("n = 1").drop("n")
    return warnings.where("phase <> -1").withColumn("line", at).join(alone, ["run_id", "line"])


def coverage(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Per run: whole calls of the raw log, events that aren't exits, calls without an event, events without a call.

    A call isn't whole if a spawn of its task came between its halves.
    """
    ship_package(lines.sparkSession)
    rows = checkpointed(classified(lines))
    spawns = checkpointed(decoded(calls(rows).where(decode.kind_of(F.col("op")) == "spawn")))
    rows = _states(rows, spawns).where("state in ('complete', 'stitched')")
    whole = rows.select("run_id", "end_line", "pid", F.col("op").alias("operation"), F.lit(1).alias("raw"), F.lit(0).alias("event"))
    saved = events.where("kind <> 'exit'").select("run_id", "end_line", "pid", "operation", F.lit(0).alias("raw"), F.lit(1).alias("event"))
    both = whole.union(saved).groupBy("run_id", "end_line", "pid", "operation").agg(F.sum("raw").alias("raw"), F.sum("event").alias("event"))
    total = lambda c: F.sum(c).cast("long")
    return both.groupBy("run_id").agg(total("raw").alias("n_calls"), total("event").alias("n_events"), total(F.greatest(F.col("raw") - F.col("event"), F.lit(0))).alias("n_missing"), total(F.greatest(F.col("event") - F.col("raw"), F.lit(0))).alias("n_extra"))


def identity_warnings(events: DataFrame) -> DataFrame:
    """One warning per generation whose origin isn't introduced, at the event that shows it."""
    rows = generations(events)
    several = rows.groupBy("run_id", "task").agg(F.count(F.lit(1)).alias("n"))
    label = lambda n: F.when(F.col("n") > 1, F.concat_ws("#", "task", n.cast("string"))).otherwise(F.col("task"))
    exits = rows.where("exit_event is not null").select("run_id", "task", (F.col("ordinal") + 1).alias("ordinal"), F.col("exit_event").alias("event_index"))
    exits = exits.join(events.select("run_id", "event_index", F.col("line").alias("exit_line")), ["run_id", "event_index"]).drop("event_index")
    opened = timeline(events).where(F.col("origin").isin(UNTRUSTED)).join(several, ["run_id", "task"]).join(exits, ["run_id", "task", "ordinal"], "left")
    me, before = label(F.col("ordinal")), label(F.col("ordinal") - 1)
    at = F.coalesce(F.concat(F.lit(f" at {FILE}:"), F.col("exit_line").cast("string")), F.lit(""))

    def filled(name: str, *values: Column) -> Column:
        parts = IDENTITY_WARNINGS[name].split("{}")
        return F.concat(F.lit(f"{name}: " + parts[0]), *(x for value, after in zip(values, parts[1:]) for x in (value, F.lit(after))))

    detail = F.when(F.col("origin") == "Unintroduced", filled("Unintroduced", me)).when(F.col("origin") == "Reappeared", filled("Reappeared", me, before, at)).otherwise(filled("LiveCollision", me, before))
    text = F.concat(F.lit(f"{FILE}:"), F.col("line").cast("string"), F.lit(": task.identity: "), detail, F.lit(f"; {IDENTITY_END}"))
    return opened.select("run_id", F.lit(IDENTITY).alias("phase"), F.col("event_index").alias("place"), F.col("seq").alias("step"), text.alias("text"))


def parse(lines: DataFrame, initial_cwd: str | None = None) -> Parsed:
    """``lines`` (run_id, line, text and, if known, terminated) to events and warnings.

    Events carry cwd_before and context_uncertain; warnings are ordered by phase, place and step.
    """
    events, warnings = observations(lines)
    events = checkpointed(events.withColumn("pair_id", F.lit(0)))
    state = checkpointed(context_state(events, initial_cwd))
    full = events.drop("pair_id").join(state.drop("warnings"), ["run_id", "event_index"])
    told = state.select("run_id", F.lit(CONTEXT).alias("phase"), F.col("event_index").alias("place"), F.posexplode("warnings").alias("step", "text"))
    return Parsed(full, warnings.unionByName(identity_warnings(events)).unionByName(told))
