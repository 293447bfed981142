"""Working-directory contexts of processes: an order-dependent state machine, one run at a time.

Contexts are shared, split and made uncertain by earlier events of other processes, and
uncertainty reaches back to events already seen, so no window expresses it. Runs are
independent: ``applyInPandas`` per run keeps them parallel. A run over MAX_EVENTS isn't loaded
into one task: each of its events keeps its row, uncertain and with a warning that says so.

A call that spans lines opens a window on its context: until it closes, nobody can say on
which side of it another member's event falls. There are three kinds: a directory change
under way, a split under way (both halves point at each other) and the copy that a child
takes at a fork. An invalidation follows open windows to the contexts at their other ends
and marks the events that opened them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.vocab import CONTEXT_REASONS as WHY
from runlens.functions.vocab import UNTRUSTED
from runlens.session import ship_package

from .lifecycle import timeline

#: Events of one run that the machine takes into one task; the budget of a saved run.
MAX_EVENTS = 1_000_000

SCHEMA = "run_id string, event_index long, cwd_before string, context_uncertain boolean, warnings array<string>"


@dataclass
class Window:
    until: int
    kind: str  # cwd, split or fork
    event: int
    other: object = None  # the new directory, or the context at the other end


@dataclass(eq=False)
class Context:
    """A file-system context that one or more tasks share."""

    cwd: str | None
    uncertain: bool
    members: int = 0
    windows: list[Window] = field(default_factory=list)

    def settle(self, line: int) -> None:
        """Close the windows that end by ``line``; a change under way takes effect."""
        for w in self.windows:
            if w.kind == "cwd" and w.until <= line and not self.uncertain:
                self.cwd = w.other
        self.windows = [w for w in self.windows if w.until > line]

    def moving(self) -> bool:
        return any(w.kind != "fork" for w in self.windows)

    def copied(self) -> bool:
        return any(w.kind == "fork" for w in self.windows)


class Machine:
    """State of one run. ``first`` gives the line of each task's first own event."""

    def __init__(self, initial_cwd: str | None = "/", first: dict | None = None):
        self.initial, self.first = initial_cwd, first or {}
        self.of: dict[tuple, Context] = {}
        self.out: dict[int, list] = {}

    def join(self, task: tuple, context: Context) -> Context:
        self.leave(task)
        self.of[task] = context
        context.members += 1
        return context

    def leave(self, task: tuple) -> None:
        if context := self.of.pop(task, None):
            context.members -= 1

    def doubt(self, contexts: list[Context], event: dict, reason: str | None = None) -> None:
        """Contexts and all that their open windows reach become uncertain for good."""
        todo, seen, hit = list(contexts), set(), [event["event_index"]] if reason else []
        while todo:
            context = todo.pop()
            if id(context) in seen or not context.members:
                continue
            seen.add(id(context))
            context.settle(event["line"])
            hit += [w.event for w in context.windows]
            todo += [w.other for w in context.windows if w.kind != "cwd"]
            context.cwd, context.uncertain, context.windows = None, True, []
        for index in hit:
            self.out[index][1] = True
        if reason:
            self.warn(event, f"fs.context: {WHY[reason]}; affected relative path context is incomplete")

    def warn(self, event: dict, text: str) -> None:
        self.out[event["event_index"]][2].append(f"raw/trace.log:{event['line']}: {text}")

    def step(self, event: dict) -> None:
        """One event in evidence order; its row is [cwd before, uncertain, warnings]."""
        task, kind, path = event["task"], event["kind"], event["path"]
        if task not in self.of:
            known = event["origin"] == "Initial"
            self.join(task, Context(self.initial if known else None, not known))
        context = self.of[task]
        context.settle(event["line"])
        cwd = None if context.uncertain or context.moving() else context.cwd
        self.out[event["event_index"]] = [cwd, context.uncertain or bool(event["untrusted"]), []]
        success = event["outcome"] == "success"
        if kind == "spawn" and success:
            if not event["child"]:
                return self.doubt([context], event, "no child")
            self.spawn(context, event)
        elif kind == "context" and success:
            self.change(context, event)
        elif kind == "exit":
            self.leave(task)
        elif kind == "cwd" and success:
            self.move(context, event)
        if (path or "").startswith("relative:") or (kind == "cwd" and path is None):
            self.out[event["event_index"]][1] = True
            if not (kind == "cwd" and success):
                self.warn(event, WHY["path"])
        if kind == "exec" and event.get("argv_missing"):
            self.warn(event, WHY["argv"])

    def move(self, context: Context, event: dict) -> None:
        path = event["path"] if (event["path"] or "").startswith("/") else None
        reason = "cwd over fork" if context.copied() else "cwd unknown" if path is None else "cwd overlap" if context.moving() else None
        if reason:
            self.doubt([context], event, reason)
        elif event["end_line"] > event["line"] and not context.uncertain:
            context.windows.append(Window(event["end_line"], "cwd", event["event_index"], path))
        elif not context.uncertain:
            context.cwd = path

    def spawn(self, parent: Context, event: dict) -> None:
        child, effect = event["child"], event.get("effect") or "PrivateFs"
        if event["collision"]:
            # The number was still in use: whoever held it is in doubt, and so is the child.
            if before := self.of.get((child[0], child[1] - 1)):
                self.doubt([before], event)
            fresh = self.join(child, Context(None, True))
            if effect == "SharedFs":
                self.doubt([parent], event)
            elif effect == "Unknown":
                self.doubt([parent], event, "spawn unknown")
            elif effect == "PrivateFsNamespaceUncertain":
                self.doubt([fresh], event, "spawn namespace")
        elif effect == "SharedFs":
            self.join(child, parent)
        elif effect == "PrivateFs" and not parent.moving():
            copy = self.join(child, Context(parent.cwd, parent.uncertain))
            until = min(event["end_line"], self.first.get(child, event["end_line"]))
            if until > event["line"] and not parent.uncertain:
                parent.windows.append(Window(until, "fork", event["event_index"], copy))
        elif effect == "PrivateFsNamespaceUncertain":
            self.doubt([self.join(child, Context(None, True))], event, "spawn namespace")
        else:
            self.doubt([parent], event, "spawn overlap" if effect == "PrivateFs" else "spawn unknown")
            self.join(child, Context(None, True))

    def change(self, context: Context, event: dict) -> None:
        task, line, end = event["task"], event["line"], event["end_line"]
        if event["operation"] in ("setns", "chroot"):
            return self.doubt([context], event, "root")
        if event["operation"] != "unshare":
            return self.doubt(list(self.of.values()), event, "mount")
        effect = event.get("effect") or "Unknown"
        if effect in ("Unknown", "ConnectedFsNamespaceUncertain"):
            self.doubt([context], event, "unshare unknown" if effect == "Unknown" else "unshare connected")
        elif effect == "SplitFs":
            if context.copied() or context.moving():
                self.doubt([context], event, "unshare over fork" if context.copied() else "unshare overlap")
            half = self.join(task, Context(context.cwd, context.uncertain))
            if end > line and not half.uncertain and context.members:
                for one, other in ((context, half), (half, context)):
                    one.windows.append(Window(end, "split", event["event_index"], other))
        elif effect == "SplitFsNamespaceUncertain":
            copied = context.copied()
            if copied:
                self.doubt([context], event, "namespace over fork")
            half = self.join(task, Context(None, True))
            if not copied:
                self.doubt([half], event, "namespace")


def resolve(rows: pd.DataFrame, initial_cwd: str | None = "/") -> pd.DataFrame:
    """The machine over the rows of one run."""
    events = rows.sort_values(["line", "end_line", "event_index"]).to_dict("records")
    first: dict[tuple, int] = {}
    for r in events:
        r["task"] = (r["pid"], int(r["ordinal"]))
        r["path"] = r["path"] if isinstance(r["path"], str) else None
        r["child"] = (r["child_pid"], int(r["child_ordinal"])) if isinstance(r["child_pid"], str) and pd.notna(r["child_ordinal"]) else None
        r["effect"] = r["effect"] if isinstance(r.get("effect"), str) else None
        first.setdefault(r["task"], r["line"])
    machine = Machine(initial_cwd, first)
    for r in events:
        machine.step(r)
    out = list(machine.out.values())
    return pd.DataFrame({"run_id": rows["run_id"].iloc[0], "event_index": list(machine.out), "cwd_before": pd.array([o[0] for o in out], dtype="object"), "context_uncertain": [o[1] for o in out], "warnings": [o[2] for o in out]})


def context_state(events: DataFrame, initial_cwd: str | None = "/") -> DataFrame:
    """Per event: the directory before it if it is certain, whether its context is uncertain, and warnings.

    ``events`` may carry ``effect`` (of spawns and of unshare; without it a spawn copies its
    parent's context and unshare is unknown) and ``argv``.
    """
    ship_package(events.sparkSession)
    rows = timeline(events)
    origins = rows.where("origin is not null").select("run_id", "task", "ordinal", F.col("origin").alias("born"))
    actors = rows.where("t <> 'C'").select("run_id", "event_index", "task", "ordinal").join(origins, ["run_id", "task", "ordinal"]).select("run_id", "event_index", "ordinal", F.col("born").alias("origin"), F.col("born").isin(UNTRUSTED).alias("untrusted"))
    births = rows.where("t = 'C'").select("run_id", "event_index", F.col("ordinal").alias("child_ordinal"), (F.col("origin") == "LiveCollision").alias("collision"))
    effect = F.col("effect") if "effect" in events.columns else F.lit(None).cast("string")
    argv_missing = F.col("argv").isNull() if "argv" in events.columns else F.lit(False)
    events = events.select("run_id", "event_index", "line", "end_line", "pid", "kind", "operation", "path", "outcome", "child_pid", effect.alias("effect"), argv_missing.alias("argv_missing"))
    full = events.join(actors, ["run_id", "event_index"]).join(births, ["run_id", "event_index"], "left").withColumn("collision", F.coalesce("collision", F.lit(False)))
    counts = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    full, limit = full.join(counts, "run_id"), F.lit(MAX_EVENTS)
    done = full.where(F.col("_n") <= limit).drop("_n").groupBy("run_id").applyInPandas(lambda part: resolve(part, initial_cwd), SCHEMA)
    said = F.concat(F.lit("context unknown: the run has "), F.col("_n").cast("string"), F.lit(f" events, more than {MAX_EVENTS}"))
    beyond = events.join(counts, "run_id").where(F.col("_n") > limit)
    return done.union(beyond.select("run_id", "event_index", F.lit(None).cast("string"), F.lit(True), F.array(said)))
