"""Process lifetimes from saved events: generations, origins, exits, roots, ancestry, stitching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.vocab import UNTRUSTED
from runlens.session import checkpointed

ORDER = ["line", "end_line", "event_index"]


def timeline(events: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per appearance of a pid: as actor (A, or X at its exit) and as introduced child (C).

    ``ordinal`` numbers the pid's generations: a child introduction always opens one, an
    actor opens one if none is active. Windows are per (run, pid). Columns named in ``carry``
    come along from the event of each row.
    """
    base = ["pair_id", "run_id", *ORDER, *carry]
    # One row a run: combined before the shuffle, and small beside the events.
    first = events.groupBy("run_id").agg(F.min(F.struct(*ORDER)).alias("first_of_run"))
    marked = events.join(first, "run_id").withColumn("is_first", F.struct(*ORDER) == F.col("first_of_run")).drop("first_of_run")
    actor = marked.select(*base, F.col("pid").alias("task"), F.lit(0).alias("seq"), F.when(F.col("kind") == "exit", "X").otherwise("A").alias("t"), "is_first")
    child = marked.where("kind = 'spawn' and outcome = 'success' and child_pid is not null").select(*base, F.col("child_pid").alias("task"), F.lit(1).alias("seq"), F.lit("C").alias("t"), F.lit(False).alias("is_first"))
    w = Window.partitionBy("run_id", "task").orderBy(*ORDER, "seq")
    rows = actor.union(child).withColumn("before", F.lag("t").over(w))
    opens = (F.col("t") == "C") | F.col("before").isNull() | (F.col("before") == "X")
    rows = rows.withColumn("opens", opens).withColumn("ordinal", F.sum(F.col("opens").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    active = F.col("before").isin("A", "C")
    origin = F.when(~F.col("opens"), None).when(F.col("t") == "C", F.when(active, "LiveCollision").otherwise("Spawned")).when(F.col("before") == "X", "Reappeared").when(F.col("is_first"), "Initial").otherwise("Unintroduced")
    return rows.withColumn("origin", origin)


def generations(events: DataFrame) -> DataFrame:
    """One row per generation: origin, first actor event, exit event."""
    actor = F.when(F.col("t") != "C", F.struct(*ORDER))
    return timeline(events).groupBy("pair_id", "run_id", "task", "ordinal").agg(
        F.max("origin").alias("origin"), F.min(actor)["event_index"].alias("first_event"), F.max(F.when(F.col("t") == "X", F.col("event_index"))).alias("exit_event"), F.count(F.lit(1)).alias("n_rows")
    )


def untrusted_events(events: DataFrame) -> DataFrame:
    """Actor events of generations whose identity isn't introduced: they are all context-uncertain."""
    w = Window.partitionBy("run_id", "task", "ordinal")
    rows = timeline(events).withColumn("generation_origin", F.max("origin").over(w))
    return rows.where((F.col("t") != "C") & F.col("generation_origin").isin(UNTRUSTED)).select("run_id", "event_index", F.col("task").alias("pid"), "ordinal", F.col("generation_origin").alias("origin"))


def missing_exits(events: DataFrame) -> DataFrame:
    """Per run the labels of introduced generations without an exit, in byte order.

    A label is the pid, or pid#ordinal where the pid has several generations.
    """
    rows = generations(events)
    several = F.count(F.lit(1)).over(Window.partitionBy("run_id", "task")) > 1
    label = F.when(several, F.concat_ws("#", "task", F.col("ordinal").cast("string"))).otherwise(F.col("task"))
    open_ = rows.withColumn("label", label).where("exit_event is null")
    return open_.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_missing"), F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("missing"))


def root_exec(events: DataFrame) -> DataFrame:
    """Per run the first successful exec in evidence order, its generation and that generation's exit."""
    execs = events.where("kind = 'exec' and outcome = 'success'")
    root = execs.groupBy("run_id").agg(F.min(F.struct(*ORDER, "pid")).alias("r"))
    at = timeline(events).where("t != 'C'").select("run_id", F.col("event_index").alias("root_event"), "task", "ordinal")
    found = root.select("run_id", F.col("r.event_index").alias("root_event"), F.col("r.pid").alias("root_pid")).join(at, ["run_id", "root_event"])
    return found.join(generations(events).select("run_id", "task", "ordinal", "exit_event"), ["run_id", "task", "ordinal"]).select("run_id", "root_event", "root_pid", "ordinal", "exit_event")


def exec_before(events: DataFrame) -> DataFrame:
    """As-of: the path of the successful exec of the same pid that was the last to end by the line where a file event begins."""
    base = ["run_id", "pid", "event_index"]
    execs = events.where("kind = 'exec' and outcome = 'success'").select(*base, F.col("end_line").alias("at"), F.lit(0).alias("asks"), "path")
    files = events.where("kind = 'file'").select(*base, F.col("line").alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("string").alias("path"))
    w = Window.partitionBy("run_id", "pid").orderBy("at", "asks", "event_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = execs.union(files).withColumn("exec_path", F.last("path", ignorenulls=True).over(w))
    return rows.where("asks = 1").select("run_id", "event_index", "pid", "exec_path")


def spawn_edges(events: DataFrame) -> DataFrame:
    """Successful spawns, each with the spawn that introduced its actor: the latest earlier one, or null."""
    births = events.where("kind = 'spawn' and outcome = 'success'").select("run_id", "line", F.col("pid").alias("parent"), F.col("child_pid").alias("child"))
    asks = births.select("run_id", F.col("parent").alias("task"), "line", F.lit(None).cast("long").alias("birth"), F.col("child"), F.lit(1).alias("ask"))
    known = births.select("run_id", F.col("child").alias("task"), "line", F.col("line").alias("birth"), F.lit(None).cast("string").alias("child"), F.lit(0).alias("ask"))
    # Strictly earlier lines: rows of one line are ordered with questions first.
    w = Window.partitionBy("run_id", "task").orderBy("line", F.desc("ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asks.union(known).withColumn("parent_line", F.last("birth", ignorenulls=True).over(w)).where("ask = 1")
    return rows.select("run_id", "line", F.col("task").alias("parent"), "child", "parent_line")


def lineage(events: DataFrame) -> DataFrame:
    """Depth and root line of each spawn by pointer doubling: log(depth) joins instead of depth."""
    edges = spawn_edges(events).select("run_id", "line", "child", "parent_line")
    rows = checkpointed(edges.select("run_id", "line", "child", F.coalesce("parent_line", "line").alias("up"), F.when(F.col("parent_line").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    while True:
        top = rows.select("run_id", F.col("line").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        after = checkpointed(rows.join(top, ["run_id", "up"]).select("run_id", "line", "child", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth")))
        if rows.agg(F.sum("up")).first() == after.agg(F.sum("up")).first():
            return after.select("run_id", "line", "child", F.col("up").alias("root_line"), "depth")
        rows = after


def stitched(lines: DataFrame, detail: bool = False) -> DataFrame:
    """Unfinished and resumed halves of calls joined into one observation.

    ``lines``: run_id, line, pid, t (U unfinished, R resumed, X exit, C complete), op, and
    optionally child (the pid that a successful spawn's C or R row introduces). Per pid at
    most one call is pending: a second U replaces it, R always consumes it, X clears it, and
    so does a spawn of that pid that was entered after it. Whether an interrupted spawn is
    whole depends on earlier lines only, so repeating the pass until its spawns stay the same
    settles all of them. With ``detail``: ``other``, the line that ended a U or began an R's call,
    and ``entered``, where the spawn began that cleared a U.
    """
    spare = ["child"] if detail else ["child", "other", "entered"]
    if "child" not in lines.columns:
        return _stitched(lines.withColumn("child", F.lit(None).cast("string"))).drop(*spare)
    births, before = None, None
    while True:
        out = checkpointed(_stitched(lines, births))
        births = out.where("child is not null and state in ('complete', 'stitched')").select("run_id", F.col("child").alias("pid"), F.col("end_line").alias("line"), F.col("line").alias("entered"))
        now = births.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*births.columns))).first()
        if now == before or not now[0]:
            return out.drop(*spare)
        before = now


def _stitched(lines: DataFrame, births: DataFrame | None = None) -> DataFrame:
    """One pass. A birth (run_id, pid, line, entered) acts on its pid if the last control row is a U before ``entered``."""
    lines = lines.select("run_id", "line", "pid", "t", "op", "child").withColumn("entered", F.lit(None).cast("long"))
    control = F.when(F.col("t").isin("U", "R", "X"), F.struct("t", "line", "op", "entered"))
    # A birth comes after the line that returns it.
    w = Window.partitionBy("run_id", "pid").orderBy("line", F.when(F.col("t") == "K", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    if births is not None:
        rows = lines.unionByName(births.withColumn("t", F.lit("K")), allowMissingColumns=True).withColumn("last", F.last(control, ignorenulls=True).over(w))
        lines = rows.where((F.col("t") != "K") | (F.col("last.t").eqNullSafe("U") & (F.col("last.line") < F.col("entered")))).drop("last")
    control = F.when(F.col("t").isin("U", "R", "X", "K"), F.struct("t", "line", "op", "entered"))
    rows = lines.withColumn("last", F.last(control, ignorenulls=True).over(w))
    rows = rows.withColumn("ahead", F.first(control, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    pending = F.col("last.t").eqNullSafe("U")
    resumed, unfinished = F.col("t") == "R", F.col("t") == "U"
    ends = {"U": "replaced", "X": "ended with exit", "K": "predates spawn entry"}
    state = F.when(resumed, F.when(~pending, "unmatched resumed").when(F.col("last.op") != F.col("op"), "resumed mismatch").otherwise("stitched"))
    state = state.when(unfinished & F.col("ahead").isNull(), "unfinished at end").when(F.col("t") == "C", "complete")
    for t, name in ends.items():
        state = state.when(unfinished & (F.col("ahead.t") == t), name)
    start = F.when(state == "stitched", F.col("last.line")).otherwise(F.col("line"))
    other = F.when(resumed & pending, F.col("last.line")).when(unfinished, F.col("ahead.line"))
    return rows.select("run_id", "pid", "op", start.alias("line"), F.col("line").alias("end_line"), state.alias("state"), "child", other.alias("other"), F.when(unfinished, F.col("ahead.entered")).alias("entered")).where(F.col("state").isNotNull())
