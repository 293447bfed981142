"""Audits of finished comparisons: expected clues, reports derived a second time, kinds of warnings.

An audit never repairs anything: it returns the rows that differ, or how often something was
seen. Both sides of each check meet in an aggregation on the change's key, so an audit costs
one exchange beside those of the report itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.vocab import ALWAYS_SHOWN, EVIDENCE_LIMIT, TAXONOMY

from .compare import KEY, comparable, presented
from .lifecycle import ORDER, root_exec

c = F.col


def clue_ranks(events: DataFrame, clues: DataFrame) -> DataFrame:
    """Where each expected change stands in its report, and who made the observations behind it.

    ``clues``: KEY, name, change, left, right (sorted outcome arrays), required. A clue is found
    only with its category and both outcome sets; else its rank is null. ``n_root`` and
    ``n_descendant`` count the events of a found clue by the root task and by others.
    """
    found = presented(events).select(*KEY, "change", "left", "right", c("position").alias("rank"))
    got = clues.join(found, [*KEY, "change", "left", "right"], "left").select(*KEY, "name", "required", "rank")
    roots = root_exec(events).select("run_id", "root_pid")
    seen = comparable(events).join(got.where("rank is not null").select(*KEY).distinct(), KEY, "left_semi").join(roots, "run_id", "left")
    by_root = F.coalesce(c("pid") == c("root_pid"), F.lit(False))
    counts = seen.groupBy(*KEY).agg(F.count(F.when(by_root, 1)).alias("n_root"), F.count(F.when(~by_root, 1)).alias("n_descendant"))
    in_top = F.coalesce(c("required") & (c("rank") <= ALWAYS_SHOWN), F.lit(False))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long")).alias(x)
    return got.join(counts, KEY, "left").select(*KEY, "name", "required", "rank", in_top.alias("in_top"), zero("n_root"), zero("n_descendant"))


def exec_successes(events: DataFrame) -> DataFrame:
    """Per run and program: how often it was executed with success, and the first events of it in evidence order."""
    rows = events.where("kind = 'exec' and outcome = 'success'")
    key = ["run_id", "path"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*ORDER))
    first = rows.withColumn("nth", nth).where(c("nth") <= EVIDENCE_LIMIT).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "event_index"))).alias("first"))
    total = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return total.join(first, key).select(*key, "n", F.transform("first", lambda x: x["event_index"]).alias("first"))


def derived_changes(events: DataFrame) -> DataFrame:
    """Changes by a second way: outcomes that only one side has, then the sets of the keys that have one."""
    side = F.max(F.when(c("side") == "left", 1).otherwise(0)) + 2 * F.max(F.when(c("side") == "right", 1).otherwise(0))
    fine = comparable(events).groupBy(*KEY, "outcome").agg(side.alias("sides"))
    of = lambda bit: F.array_sort(F.collect_list(F.when(c("sides").bitwiseAND(bit) > 0, c("outcome"))))
    rows = fine.groupBy(*KEY).agg(of(1).alias("left"), of(2).alias("right"), F.bool_or(c("sides") < 3).alias("differs"), F.bool_or(c("outcome") != "success").alias("failed"))
    of_exec = F.when(c("failed"), "ExecutionAttempt").otherwise("Executable")
    of_file = F.when(F.size("left") == 0, "NewFileAccess").when(F.size("right") == 0, "RemovedFileAccess").otherwise("FileAccessOutcome")
    return rows.where("differs").select(*KEY, F.when(c("kind") == "exec", of_exec).otherwise(of_file).alias("change"), "left", "right")


def report_faults(events: DataFrame, report: DataFrame) -> DataFrame:
    """Keys where a report (KEY, change, left, right) departs from its events, each with its first fault.

    Faults, in this order: duplicate, omitted, extra, outcomes, category.
    """
    cols = [*KEY, "change", "left", "right"]
    both = report.select(*cols, F.lit(1).alias("said")).union(derived_changes(events).select(*cols, F.lit(0).alias("said")))
    of = lambda said, name: F.max(F.when(c("said") == said, c(name))).alias(f"{name}{said}")
    rows = both.groupBy(*KEY).agg(F.sum("said").alias("n_said"), F.count(F.when(c("said") == 0, 1)).alias("n_true"), *(of(s, x) for s in (0, 1) for x in ("change", "left", "right")))
    same = c("left0").eqNullSafe(c("left1")) & c("right0").eqNullSafe(c("right1"))
    fault = F.when(c("n_said") > 1, "duplicate").when(c("n_said") == 0, "omitted").when(c("n_true") == 0, "extra").when(~same, "outcomes").when(~c("change0").eqNullSafe(c("change1")), "category")
    return rows.select(*KEY, fault.alias("fault")).where("fault is not null")


def warning_category(text: Column, taxonomy: dict[str, str] = TAXONOMY) -> Column:
    """The first category whose pattern the warning matches, else ``unclassified``."""
    category = F.when(F.lit(False), "")
    for name, pattern in taxonomy.items():
        category = category.when(text.rlike(pattern), name)
    return category.otherwise("unclassified")


def warning_counts(warnings: DataFrame, taxonomy: dict[str, str] = TAXONOMY) -> DataFrame:
    """Per run and category how many warnings there are. ``warnings``: run_id, text."""
    return warnings.groupBy("run_id", warning_category(c("text"), taxonomy).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def warning_faults(warnings: DataFrame, expected: DataFrame, taxonomy: dict[str, str] = TAXONOMY) -> DataFrame:
    """Categories whose number departs from ``expected`` (run_id, category, n): surplus > 0 is too many.

    An expected n of 0 equals no row at all.
    """
    wanted = expected.select("run_id", "category", (-c("n")).alias("n"))
    return warning_counts(warnings, taxonomy).union(wanted).groupBy("run_id", "category").agg(F.sum("n").alias("surplus")).where("surplus <> 0")
