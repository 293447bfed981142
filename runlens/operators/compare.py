"""Run comparison: group, merge, classify, rank, sample, fold. Every key starts with pair_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import quoted
from runlens.functions.vocab import ALWAYS_SHOWN, DETAIL_FAILED, DETAIL_TEMPORARY, EVIDENCE_LIMIT, NOT_SELECTED, UNSET

KEY = ["pair_id", "kind", "operation", "path"]


def comparable(events: DataFrame) -> DataFrame:
    """Observations that take part in a comparison: file and exec events with a path."""
    return events.where(F.col("kind").isin("file", "exec") & F.col("path").isNotNull())


def outcome_sets(events: DataFrame) -> DataFrame:
    """Per key and side: the sorted set of outcomes and the number of events.

    Two levels: (key, side, outcome) combines map-side whatever the number of events.
    """
    fine = comparable(events).groupBy(*KEY, "side", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return fine.groupBy(*KEY, "side").agg(F.array_sort(F.collect_list("outcome")).alias("outcomes"), F.sum("n").alias("n_events"))


def merged(events: DataFrame) -> DataFrame:
    """Both sides of each key: a full outer merge of the two keyed aggregates.

    Both sides have the same key partitioning after their aggregation; pivoting inside one
    more aggregation on the same key takes the place of the join and needs no exchange.
    """
    sets = outcome_sets(events)
    side = lambda name, col: F.max(F.when(F.col("side") == name, F.col(col)))
    empty = F.array().cast("array<string>")
    out = sets.groupBy(*KEY).agg(*(side(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("outcomes", "n_events")))
    return out.select(*KEY, *(F.coalesce(f"{s}_outcomes", empty).alias(s) for s in ("left", "right")), *(F.coalesce(f"{s}_n_events", F.lit(0)).cast("long").alias(f"n_{s}") for s in ("left", "right")))


def changes(events: DataFrame) -> DataFrame:
    """Keys whose outcome sets differ, with change kind and rank class."""
    rows = merged(events).where(~F.col("left").eqNullSafe(F.col("right")))
    failed = F.exists(F.concat("left", "right"), lambda o: o != "success")
    no_left, no_right = F.size("left") == 0, F.size("right") == 0
    change = F.when(F.col("kind") == "exec", F.when(failed, "ExecutionAttempt").otherwise("Executable")).when(no_left, "NewFileAccess").when(no_right, "RemovedFileAccess").otherwise("FileAccessOutcome")
    rows = rows.withColumn("change", change)
    lost = (F.array_join("left", ",") == "success") & ~no_right & ~F.array_contains("right", "success")
    failing = ~no_right & ~F.array_contains("right", "success")
    rank = (
        F.when(lost, 3)
        .when((F.col("change") == "ExecutionAttempt") & failing, 4)
        .when((F.col("change") == "Executable") & ~no_right, 5)
        .when(F.col("change") == "NewFileAccess", 6)
        .when(F.col("change") == "Executable", 7)
        .when(F.col("change").isin("FileAccessOutcome", "ExecutionAttempt"), 8)
        .otherwise(9)
    )
    return rows.withColumn("rank_class", rank)


def ranked(events: DataFrame) -> DataFrame:
    """Changes with production order and rank; windows are per pair and see changes only."""
    w = Window.partitionBy("pair_id")
    rows = changes(events).withColumn("comparison_order", F.row_number().over(w.orderBy("kind", "operation", "path")).cast("long"))
    return rows.withColumn("rank", F.row_number().over(w.orderBy("rank_class", "comparison_order")).cast("long"))


def temporary(path) -> F.col:
    """Whether a path looks temporary: compiler scratch names, object writes, assembler files."""
    leaf = F.regexp_extract(path, "[^/]*$", 0)
    scratch = path.rlike(r"(^|/)(rustc|rmeta|\.tmp)[A-Za-z0-9]{6}(/|$)")
    objects = path.contains("/objects/") & leaf.rlike(r"^tmp_obj_[A-Za-z0-9]{6}$")
    assembler = path.startswith("/tmp/") & leaf.rlike(r"^cc[A-Za-z0-9]{6}\.s$")
    return scratch | objects | assembler


def detail_groups(events: DataFrame) -> DataFrame:
    """Ranked changes with the fold group of one-sided file accesses, or null."""
    one_sided = (F.size("left") == 0) | (F.size("right") == 0)
    all_failed = F.forall(F.concat("left", "right"), lambda o: o != "success")
    group = F.when((F.col("kind") != "file") | ~one_sided, None).when(all_failed, DETAIL_FAILED).when(temporary(F.col("path")), DETAIL_TEMPORARY)
    return ranked(events).withColumn("detail_group", group)


def presented(events: DataFrame) -> DataFrame:
    """Changes in presentation order: folded groups last, then rank class and production order."""
    rows = detail_groups(events).withColumn("priority", F.when(F.col("detail_group").isNotNull(), 10).otherwise(F.col("rank_class")))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("pair_id").orderBy("priority", "comparison_order")).cast("long"))


def folded(events: DataFrame) -> DataFrame:
    """Per pair and detail group: how many changes fold and the first three positions."""
    rows = presented(events).where((F.col("position") > ALWAYS_SHOWN) & F.col("detail_group").isNotNull())
    nth = F.row_number().over(Window.partitionBy("pair_id", "detail_group").orderBy("position"))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.col("position")))), ",")
    return rows.withColumn("nth", nth).groupBy("pair_id", "detail_group").agg(F.count(F.lit(1)).alias("n"), first.alias("first_positions"))


def evidence_samples(events: DataFrame) -> DataFrame:
    """At most three events per key and side of a change.

    First the first event of each outcome that the other side lacks, then events of shared
    outcomes, then the others whose coordinates aren't taken yet.

    No more than the first three events and the first three coordinates of an outcome can
    win a slot, so they are cut first: a rank limit that works before the shuffle, and a
    minimum per coordinate. The ranking proper sees at most six rows an outcome.
    """
    group = [*KEY, "side", "outcome"]
    base = comparable(events).select(*group, "event_index", "line", "end_line")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("event_index"))
    first = base.withColumn("nth", nth).where(F.col("nth") <= EVIDENCE_LIMIT).drop("nth")
    places = base.groupBy(*group, "line", "end_line").agg(F.min("event_index").alias("event_index")).withColumn("nth", nth).where(F.col("nth") <= EVIDENCE_LIMIT)
    few = first.union(places.select(*first.columns)).distinct()
    rows = few.join(changes(events).select(*KEY, "left", "right"), KEY)
    other = F.when(F.col("side") == "left", F.col("right")).otherwise(F.col("left"))
    rows = rows.withColumn("shared", F.array_contains(other, F.col("outcome"))).withColumn("nth", nth)
    rows = rows.withColumn("pass", F.when(F.col("shared"), 2).when(F.col("nth") == 1, 1).otherwise(3))
    twin = F.row_number().over(Window.partitionBy(*KEY, "side", "line", "end_line").orderBy("pass", "outcome", "event_index"))
    rows = rows.withColumn("twin", twin).where((F.col("pass") < 3) | (F.col("twin") == 1))
    slot = F.row_number().over(Window.partitionBy(*KEY, "side").orderBy("pass", "outcome", "event_index"))
    return rows.withColumn("slot", slot.cast("long")).where(F.col("slot") <= EVIDENCE_LIMIT).select(*KEY, "side", "slot", "outcome", "event_index", "line", "end_line")


def mapping_counts(events: DataFrame) -> DataFrame:
    """Per key and side of a change: events, sampled events and omitted events."""
    sampled = evidence_samples(events).groupBy(*KEY, "side").agg(F.count(F.lit(1)).alias("n_sampled"))
    sets = outcome_sets(events).join(changes(events).select(*KEY), KEY)
    out = sets.join(sampled, [*KEY, "side"], "left").withColumn("n_sampled", F.coalesce("n_sampled", F.lit(0)).cast("long"))
    return out.select(*KEY, "side", "n_events", "n_sampled", (F.col("n_events") - F.col("n_sampled")).alias("n_omitted"))


def environment_changes(environments: DataFrame) -> DataFrame:
    """Three-valued comparison of environment maps (pair_id, left, right: map<string,string>).

    A key may be missing (not selected), null (selected, unset) or a value, empty or not; a
    null map (a record without selection data) selects nothing.
    """
    empty = F.create_map().cast("map<string,string>")
    known = environments.select("pair_id", F.coalesce("left", empty).alias("left"), F.coalesce("right", empty).alias("right"))
    keys = known.select("*", F.explode(F.array_union(F.map_keys("left"), F.map_keys("right"))).alias("name"))
    value = lambda m: F.try_element_at(F.col(m), F.col("name"))
    state = lambda m: F.when(~F.map_contains_key(F.col(m), F.col("name")), NOT_SELECTED).when(value(m).isNull(), UNSET).otherwise(F.concat(F.lit("value="), quoted(value(m))))
    out = keys.select("pair_id", "name", state("left").alias("before"), state("right").alias("after"))
    return out.where("before <> after")


def report_status(sides: DataFrame, n_changes: DataFrame) -> DataFrame:
    """Exit status per pair: 2 if a side failed to load, 3 if one isn't trusted, 1 with changes, else 0.

    ``sides``: pair_id, side, loaded, capture, storage, raw, provenance (the last two may be null).
    """
    verified = lambda c: F.col(c).isNull() | (F.col(c) == "verified")
    trusted = (F.col("capture") == "complete") & (F.col("storage") == "verified") & verified("raw") & verified("provenance")
    per = sides.groupBy("pair_id").agg(F.bool_and("loaded").alias("loaded"), F.bool_and(F.coalesce(trusted, F.lit(False))).alias("trusted"))
    rows = per.join(n_changes, "pair_id", "left").withColumn("n_changes", F.coalesce("n_changes", F.lit(0)).cast("long"))
    status = F.when(~F.col("loaded"), 2).when(~F.col("trusted"), 3).when(F.col("n_changes") > 0, 1).otherwise(0)
    return rows.select("pair_id", "n_changes", status.alias("exit_code"))
