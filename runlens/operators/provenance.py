"""Saved task generations and target provenance against what the saved events themselves say.

The ordinals that were saved are replayed from the rows alone: who acts, who is introduced
and who exits decides which ordinal each row must carry. All of it is windows per (run, task)
and two aggregations with partial results; references into the events are one join.

Events are expected to satisfy the event rules of ``records`` (only successful spawns carry a
child). A run without events has no failing row. Null annotations count as wrong ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.vocab import REPLAY_ERRORS as SAYS
from runlens.functions.vocab import UNTRUSTED

from .lifecycle import ORDER, timeline
from .records import first_failure, no

CARRIED = ("kind", "outcome", "task_generation", "child_generation", "context_uncertain")


def replayed(events: DataFrame) -> DataFrame:
    """Per run: the first contradiction of its saved rows, open lifetimes, doubt about identities, root and its exit.

    ``events``: pair_id, run_id, event_index, line, end_line, pid, kind, outcome, child_pid,
    task_generation, child_generation, context_uncertain.
    """
    rows = timeline(events, CARRIED)
    w = Window.partitionBy("run_id", "task", "ordinal")
    rows = rows.withColumn("born", F.max("origin").over(w))
    child, doubted = F.col("t") == "C", F.coalesce("context_uncertain", F.lit(False))
    certain = F.col("born").isin(UNTRUSTED) & ~doubted
    collides = (F.col("origin") == "LiveCollision") & ~doubted
    rows = rows.withColumn("says", F.when(~child, F.when(no(F.col("task_generation") == F.col("ordinal")), 0).when(certain, 1)).otherwise(F.when(no(F.col("child_generation") == F.col("ordinal")), 2).when(collides, 3)))
    place = F.struct(*ORDER)
    root = ~child & (F.col("kind") == "exec") & (F.col("outcome") == "success")
    lives = rows.groupBy("run_id", "task", "ordinal").agg(
        F.min(F.when(F.col("says").isNotNull(), F.struct(*ORDER, "says"))).alias("failure"), F.max("born").isin(UNTRUSTED).alias("doubtful"),
        F.min(F.when(root, place)).alias("root"), F.min(F.when(F.col("t") == "X", place))["event_index"].alias("exit_event"),
    )
    of_root = F.when(F.col("root").isNotNull(), F.struct("root", "task", "ordinal", "exit_event"))
    runs = lives.groupBy("run_id").agg(F.min("failure").alias("failure"), F.bool_or("doubtful").alias("doubtful"), F.count(F.when(F.col("exit_event").isNull(), 1)).alias("n_open"), F.min(of_root).alias("root"))
    text = F.element_at(F.array(*map(F.lit, SAYS["rows"])), F.col("failure.says") + 1)
    return runs.select("run_id", F.when(F.col("failure").isNotNull(), text).alias("row_error"), F.col("failure.event_index").alias("row_event"), "doubtful", "n_open", F.col("root.root.event_index").alias("root_event"), F.col("root.task").alias("root_pid"), F.col("root.ordinal").alias("root_generation"), F.col("root.exit_event").alias("root_exit"))


def _reference(role: str, rules: list[tuple[Column, str]]) -> list[tuple[Column, str]]:
    """The checks of one saved reference, then those that only its role has."""
    p, r, e = F.col("target_provenance"), F.col(f"target_provenance.{role}"), F.col(role)
    same = [e[x].eqNullSafe(r["evidence"][x]) for x in ("file", "line", "end_line")]
    return [
        (e.isNull(), SAYS["bounds"]),
        (~(same[0] & same[1] & same[2]), SAYS["coordinates"]),
        (no((e["pid"] == p["root"]["pid"]) & (e["task_generation"] == p["root"]["generation"])), SAYS["lifetime"]),
        *rules,
    ]


def provenance_errors(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Per run why its provenance doesn't hold, or null: rows first, then limits, then the references.

    ``runs``: run_id, completeness, warnings (array), target_exit_raw, target_provenance
    (schema_version, selection_rule, identity_contract, root (pid, generation), root_exec and
    target_exit (index, evidence (file, line, end_line))). The saved envelope itself is judged
    by ``records.provenance_rules``. ``events`` as in ``replayed``, and file.
    """
    refs = runs.where("target_provenance is not null").select("run_id", F.explode(F.array(*(F.struct(F.lit(role).alias("role"), F.col(f"target_provenance.{role}.index").alias("event_index")) for role in ("root_exec", "target_exit")))).alias("r"))
    refs = refs.select("run_id", "r.*")
    held = ["pid", "kind", "outcome", "task_generation", "file", "line", "end_line"]
    found = refs.join(events.select("run_id", "event_index", F.struct(*held).alias("event")), ["run_id", "event_index"])
    found = found.groupBy("run_id").agg(*(F.max(F.when(F.col("role") == role, F.col("event"))).alias(role) for role in ("root_exec", "target_exit")))
    rows = runs.join(replayed(events), "run_id", "left").join(found, "run_id", "left")
    unlimited = (F.col("completeness").eqNullSafe("complete_for_supported_events")) | (F.coalesce(F.size("warnings"), F.lit(0)) < 1)
    p = F.col("target_provenance")
    index = lambda role: p[role]["index"]
    is_root = (F.col("root_exec.kind") == "exec") & (F.col("root_exec.outcome") == "success") & (F.col("root_event") == index("root_exec"))
    # Of the lifetime that the provenance names; past the checks of the root it is the lifetime of the root.
    is_exit = (F.col("target_exit.kind") == "exit") & (F.col("root_exit") == index("target_exit")) & F.col("target_exit_raw").eqNullSafe(F.col("target_exit.outcome"))
    of_refs = first_failure(_reference("root_exec", []) + _reference("target_exit", [(no(is_root), SAYS["root"]), (no(is_exit), SAYS["exit"])]))
    whole = first_failure([
        ((F.col("n_open") > 0) & unlimited, SAYS["open"]),
        (F.coalesce("doubtful", F.lit(False)) & unlimited, SAYS["doubtful"]),
        (p.isNull() & F.col("root_exit").isNotNull(), SAYS["absent"]),
    ])
    return rows.select("run_id", F.coalesce("row_error", whole, F.when(p.isNotNull(), of_refs)).alias("error"), F.when(F.col("row_error").isNotNull(), F.col("row_event")).alias("event_index"))
