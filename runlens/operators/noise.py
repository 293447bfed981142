"""Analytics over differences: recurring families, paired subtrees, crosstabs, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compare import comparable


def path_slots(paths: DataFrame) -> DataFrame:
    """Tokens of a path (words and the separators / . _ -) with their place."""
    return paths.select("path", F.posexplode(F.regexp_extract_all("path", F.lit("[^/._-]+|[/._-]"), F.lit(0))).alias("at", "token"))


def calls(events: DataFrame) -> DataFrame:
    return comparable(events).groupBy("pair_id", "side", "operation", "path").agg(F.count(F.lit(1)).alias("n"))


def recurring_families(events: DataFrame, least: int = 2) -> DataFrame:
    """Patterns with one path part masked that recur on both sides with disjoint values and equal call counts.

    Counts and the sums of hashes decide first: patterns that recur too rarely on a side, or
    whose numbers of calls can't be the same multiset, are gone before any list is built.
    """
    rows = calls(events).withColumn("parts", F.split("path", "/"))
    slots = rows.select("pair_id", "side", "operation", "n", "parts", F.posexplode("parts").alias("at", "value")).where("value <> ''")
    masked = F.array_join(F.transform("parts", lambda p, i: F.when(i == F.col("at"), "*").otherwise(p)), "/")
    slots = slots.withColumn("pattern", masked)
    key = ["pair_id", "operation", "pattern"]
    of_side = lambda s, c: F.when(F.col("side") == s, c)
    some = F.shiftright(F.xxhash64("n"), 20)
    tally = slots.groupBy(*key).agg(*(x for s in ("left", "right") for x in (F.count(of_side(s, F.lit(1))).alias(f"{s}_k"), F.coalesce(F.sum(of_side(s, some)), F.lit(0)).alias(f"{s}_sum"))))
    fit = tally.where((F.col("left_k") >= least) & (F.col("left_k") == F.col("right_k")) & (F.col("left_sum") == F.col("right_sum"))).select(*key)
    of = lambda s, c: F.array_sort(F.collect_list(of_side(s, F.col(c))))
    grouped = slots.join(fit, key, "left_semi").groupBy(*key).agg(*(of(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("value", "n")))
    fits = ~F.arrays_overlap("left_value", "right_value") & (F.col("left_n") == F.col("right_n"))
    return grouped.where(fits).select(*key, F.size("left_value").cast("long").alias("n_left"), F.array_join("left_value", ",").alias("left_values"), F.array_join("right_value", ",").alias("right_values"))


def paired_subtrees(events: DataFrame, least: int = 3) -> DataFrame:
    """Prefix pairs (one a side) that share at least ``least`` relative paths with equal operation and count.

    A relative key (operation, count, rest) counts only if one prefix a side has it: such a
    key names its pair by itself, so both sides meet in one aggregation instead of a join.
    """
    rows = calls(events).select("pair_id", "side", "operation", "n", F.regexp_extract("path", "^(/[^/]*/[^/]*)/", 1).alias("prefix"), F.regexp_extract("path", "^/[^/]*/[^/]*(/.*)$", 1).alias("rest")).where("prefix <> ''")
    of = lambda s, f: f(F.when(F.col("side") == s, F.col("prefix")))
    keys = rows.groupBy("pair_id", "operation", "n", "rest").agg(*(x for s in ("left", "right") for x in (of(s, F.count).alias(f"{s}_k"), of(s, F.min).alias(f"{s}_prefix"))))
    both = keys.where("left_k = 1 and right_k = 1 and left_prefix <> right_prefix")
    return both.groupBy("pair_id", "left_prefix", "right_prefix").agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= least)


def outcome_crosstab(events: DataFrame) -> DataFrame:
    return events.groupBy("pair_id", "kind", "outcome").agg(F.sum((F.col("side") == "left").cast("long")).alias("n_left"), F.sum((F.col("side") == "right").cast("long")).alias("n_right"))


def calls_histogram(events: DataFrame) -> DataFrame:
    """How many keys have how many calls, per side."""
    return calls(events).groupBy("side", F.col("n").alias("n_calls")).agg(F.count(F.lit(1)).alias("n_keys"), F.countDistinct("path").alias("n_paths"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows with different multiplicities on both sides: empty if the multisets are equal."""
    key = left.columns
    both = left.withColumn("_s", F.lit(1)).union(right.withColumn("_s", F.lit(-1)))
    return both.groupBy(*key).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def interval_gaps(events: DataFrame) -> DataFrame:
    """Per event that spans lines: how many other events of its task begin strictly between its first and last line.

    A range join by counting: both ends of the span ask how many of the task's events begin
    up to there, in one window per (run, task).
    """
    base = ["run_id", "pid"]
    begin = events.select(*base, F.col("line").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("event_index"), F.lit(0).cast("long").alias("sign"))
    spans = events.where("end_line > line")
    # Up to the first line (itself included), and before the last line: questions there come ahead of what begins there.
    first = spans.select(*base, F.col("line").alias("at"), F.lit(1).alias("asks"), "event_index", F.lit(-1).cast("long").alias("sign"))
    last = spans.select(*base, F.col("end_line").alias("at"), F.lit(-1).alias("asks"), "event_index", F.lit(1).cast("long").alias("sign"))
    w = Window.partitionBy(*base).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = begin.union(first).union(last).withColumn("n", F.sum((F.col("asks") == 0).cast("long")).over(w))
    return rows.where("asks <> 0").groupBy("run_id", "event_index").agg(F.sum(F.col("sign") * F.col("n")).alias("n_between"))
