"""Experimental folding of generated files: actor identities, eligibility, two grouping rules, a disjoint view.

``events`` carry ``flags`` (array of O_ names of the raw call) beside the comparison's
columns and pid, child_pid. Members are 0-based presentation indexes of changes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import checkpointed, ship_package

from . import compare

c = F.col
ORDER = ["line", "end_line", "event_index"]
RECURRING, SUBTREE = "R1-recurring-generated-family", "R2-paired-generated-subtree"
LINEAGE = ["pid", "parent_pid", "actor", "parent"]


def _as_of(asks: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """``asks`` with the latest earlier ``value`` of ``known`` of the same (run_id, task); ties see the state before."""
    fields = {f.name: f.dataType for f in known.schema.fields}
    left = asks.withColumn("_ask", F.lit(1)).withColumn(value, F.lit(None).cast(fields[value]))
    right = known.select("run_id", "task", *ORDER, value).withColumn("_ask", F.lit(0))
    w = Window.partitionBy("run_id", "task").orderBy(*ORDER, F.desc("_ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return rows.where("_ask = 1").drop("_ask")


def identities(events: DataFrame) -> DataFrame:
    """What gives a task its program: run_id, task, order, node, value.

    A successful exec gives its path; a birth gives what the parent had, found by pointer
    doubling over births, so a chain of d births takes log(d) joins.
    """
    base = ["run_id", *ORDER]
    execs = events.where("kind = 'exec' and outcome = 'success'").select(*base, c("pid").alias("task"), c("event_index").alias("node"), c("path").alias("value"), F.lit(None).cast("long").alias("up"))
    births = events.where("kind = 'spawn' and child_pid is not null").select(*base, c("pid").alias("parent_pid"), c("child_pid").alias("task"), c("event_index").alias("node"))
    setters = execs.select(*base, "task", "node").union(births.select(*base, "task", "node"))
    asks = births.select(*base, c("parent_pid").alias("task"), c("task").alias("child"), c("node").alias("birth"))
    born = _as_of(asks, setters, "node").select(*base, c("child").alias("task"), c("birth").alias("node"), F.lit(None).cast("string").alias("value"), c("node").alias("up"))
    rows = checkpointed(execs.union(born))
    while rows.where("up is not null").limit(1).count():
        top = rows.select("run_id", c("node").alias("up"), c("value").alias("value2"), c("up").alias("up2"))
        rows = checkpointed(rows.join(top, ["run_id", "up"], "left").select(*base, "task", "node", F.coalesce("value", "value2").alias("value"), F.when(F.coalesce("value", "value2").isNull(), c("up2")).alias("up")))
    return rows.drop("up")


def actors(events: DataFrame) -> DataFrame:
    """File events with the program of their task and of its parent as of the event."""
    known = identities(events)
    nodes = known.select("run_id", "node", "value")
    births = events.where("kind = 'spawn' and child_pid is not null").select("run_id", *ORDER, c("child_pid").alias("task"), c("pid").alias("parent_pid"))
    rows = events.where("kind = 'file'").withColumn("task", c("pid"))
    rows = _as_of(_as_of(rows, known, "node"), births, "parent_pid").withColumnRenamed("node", "own")
    rows = _as_of(rows.withColumn("task", c("parent_pid")), known, "node")
    rows = rows.join(nodes.select("run_id", c("node").alias("own"), c("value").alias("actor")), ["run_id", "own"], "left")
    return rows.join(nodes.select("run_id", "node", c("value").alias("_parent")), ["run_id", "node"], "left").withColumn("parent", F.when(c("parent_pid").isNull(), "<trace boundary>").otherwise(c("_parent"))).drop("own", "node", "_parent", "task")


def eligible(events: DataFrame) -> DataFrame:
    """One-sided changes of files that one known task wrote anew: pair_id, index, side, operation, path, n, lineage."""
    wrote = (c("outcome") == "success") & F.array_contains("flags", "O_CREAT") & F.arrays_overlap("flags", F.array(F.lit("O_EXCL"), F.lit("O_TRUNC")))
    line = F.struct(*LINEAGE)
    made = actors(events).groupBy("pair_id", "side", "operation", "path").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(wrote, F.lit(False))).alias("made"), F.min(line).alias("lineage"), F.max(line).alias("_last"))
    made = made.where(c("made") & c("lineage").eqNullSafe(c("_last")) & c("lineage.actor").isNotNull()).drop("made", "_last")
    only = lambda s: F.array_join(s, ",") == "success"
    side = F.when((F.size("left") == 0) & only("right"), "right").when((F.size("right") == 0) & only("left"), "left")
    ones = compare.presented(events).where("kind = 'file'").select("pair_id", "operation", "path", (c("position") - 1).alias("index"), side.alias("side")).where("side is not null")
    return ones.join(made, ["pair_id", "side", "operation", "path"])


def _slots(rows: DataFrame) -> DataFrame:
    """Each place of a path that a changing name may fill: a part of at least four letters and digits."""
    tokens = F.regexp_extract_all("path", F.lit("[^/._-]+|[/._-]"), F.lit(0))
    rows = rows.withColumn("tokens", tokens).select("*", F.posexplode("tokens").alias("at", "value"))
    return rows.where(c("value").rlike(r"^[\p{L}\p{N}]{4,}$"))


def _masked(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t, i: F.when(i == c("at"), "{slot}").otherwise(t)), "")


def _gate(prefix: str = "") -> Column:
    """One writer a side, and the same programs on both: numbers of tasks are never compared across runs."""
    low, high = lambda s: c(f"{prefix}{s}_low"), lambda s: c(f"{prefix}{s}_high")
    programs = F.struct(low("left")["actor"], low("left")["parent"]).eqNullSafe(F.struct(low("right")["actor"], low("right")["parent"]))
    return low("left").eqNullSafe(high("left")) & low("right").eqNullSafe(high("right")) & programs


def recurring(rows: DataFrame) -> DataFrame:
    """Paths that differ in one slot, at least two a side, with disjoint values and equal call counts."""
    of = lambda s, x: F.when(c("side") == s, c(x))
    listed = [F.array_sort(F.collect_list(of(s, x))).alias(f"{s}_{x}") for s in ("left", "right") for x in ("value", "n", "index")]
    ends = [f(of(s, "lineage")).alias(f"{s}_{n}") for s in ("left", "right") for n, f in (("low", F.min), ("high", F.max))]
    got = _slots(rows).withColumn("pattern", _masked(c("tokens"))).groupBy("pair_id", "pattern", "operation").agg(*listed, *ends)
    fits = (F.size("left_index") >= 2) & (F.size("right_index") >= 2) & ~F.arrays_overlap("left_value", "right_value") & (c("left_n") == c("right_n"))
    members = F.array_sort(F.concat("left_index", "right_index"))
    return got.where(fits & _gate()).select("pair_id", F.lit(RECURRING).alias("rule"), "pattern", "operation", members.alias("members"), c("left_low.actor").alias("writer"), c("left_low.parent").alias("parent"))


def paired_subtrees(rows: DataFrame) -> DataFrame:
    """Directories that differ in one slot and share at least three unique (relative path, operation, calls)."""
    cut = F.array_position(F.slice("tokens", c("at") + 2, F.greatest(F.size("tokens") - c("at") - 1, F.lit(0))), "/").cast("int")
    rows = _slots(rows).withColumn("cut", cut).where("cut > 0").withColumn("end", c("at") + c("cut"))
    head = F.slice("tokens", F.lit(1), c("end"))
    rows = rows.withColumn("pattern", _masked(head)).withColumn("literal", F.array_join(head, "")).withColumn("rel", F.array_join(F.slice("tokens", c("end") + 2, F.size("tokens")), ""))
    of = lambda s, x: F.when(c("side") == s, c(x))
    pairs = [(s, x, f) for s in ("left", "right") for x, f in (("low", F.min), ("high", F.max))]
    keys = rows.groupBy("pair_id", "pattern", "rel", "operation", "n").agg(
        *(F.count(of(s, "index")).alias(f"{s}_rows") for s in ("left", "right")), *(F.max(of(s, "index")).alias(f"{s}_index") for s in ("left", "right")),
        *(F.max(of(s, "lineage")).alias(f"{s}_lineage") for s in ("left", "right")), *(f(of(s, "literal")).alias(f"{s}_literal_{x}") for s, x, f in pairs),
    )
    shared = (c("left_rows") == 1) & (c("right_rows") == 1)
    got = keys.groupBy("pair_id", "pattern").agg(
        F.count(F.when(shared, 1)).alias("n_shared"), F.array_sort(F.flatten(F.collect_list(F.when(shared, F.array("left_index", "right_index"))))).alias("members"),
        *(f(F.when(shared, c(f"{s}_lineage"))).alias(f"{s}_{x}") for s, x, f in pairs), *(f(f"{s}_literal_{x}").alias(f"{s}_literal_{x}") for s, x, f in pairs),
    )
    one = (c("left_literal_low") == c("left_literal_high")) & (c("right_literal_low") == c("right_literal_high")) & (c("left_literal_low") != c("right_literal_low"))
    return got.where((c("n_shared") >= 3) & one & _gate()).select("pair_id", F.lit(SUBTREE).alias("rule"), "pattern", F.lit(None).cast("string").alias("operation"), "members", c("left_low.actor").alias("writer"), c("left_low.parent").alias("parent"))


VIEW = "pair_id long, group_id string, rule string, pattern string, operation string, members array<long>, writer string, parent string"


def pick(part: pd.DataFrame) -> pd.DataFrame:
    """Greedy choice of one pair's proposals, the largest first; overlapping ones are dropped whole."""
    used, kept = set(), []
    part = part.assign(size=[-len(m) for m in part["members"]]).sort_values(["size", "rule", "pattern"], kind="stable")
    for row in part.to_dict("records"):
        members = {int(m) for m in row["members"]}
        if not used & members:
            used |= members
            kept.append({**row, "group_id": f"G{len(kept) + 1}", "members": sorted(members)})
    return pd.DataFrame(kept, columns=["pair_id", "group_id", "rule", "pattern", "operation", "members", "writer", "parent"])


def candidate_groups(events: DataFrame) -> DataFrame:
    """Disjoint groups of every pair. The choice is sequential, so it runs per pair on proposals only."""
    ship_package(events.sparkSession)
    rows = checkpointed(eligible(events))
    return recurring(rows).union(paired_subtrees(rows)).groupBy("pair_id").applyInPandas(pick, VIEW)


def candidate_view(events: DataFrame) -> DataFrame:
    """Every change once: by itself or in its group (pair_id, raw_index, group_id, n_changes), by first index."""
    groups = checkpointed(candidate_groups(events))
    inside = groups.select("pair_id", "group_id", F.explode("members").alias("index"))
    every = compare.presented(events).select("pair_id", (c("position") - 1).alias("index")).join(inside, ["pair_id", "index"], "left")
    alone = F.when(c("group_id").isNull(), c("index"))
    return every.groupBy("pair_id", "group_id", alone.alias("alone")).agg(F.min("index").alias("raw_index"), F.count(F.lit(1)).alias("n_changes")).drop("alone")


def group_details(events: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Every event behind the members of each group, with its program, its parent's and its flags."""
    groups = candidate_groups(events) if groups is None else groups
    inside = groups.select("pair_id", "group_id", F.explode("members").alias("index"))
    members = compare.presented(events).select(*compare.KEY, (c("position") - 1).alias("index")).join(inside, ["pair_id", "index"])
    return actors(events).join(members, compare.KEY).select("pair_id", "group_id", "index", "side", "operation", "path", "event_index", "actor", "parent", "flags", "outcome")
