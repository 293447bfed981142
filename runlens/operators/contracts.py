"""Data contracts and reductions as ordered CASE columns: the first failing rule wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.decode import kind_of


def first_failure(rules: list[tuple[Column, str]]) -> Column:
    """Message of the first rule whose condition is true; an unknown condition doesn't fail."""
    out = None
    for condition, message in rules:
        out = F.when(condition, message) if out is None else out.when(condition, message)
    return out


def shape_errors(events: DataFrame) -> DataFrame:
    """Events that break the row contract, with the first broken rule."""
    path, kind = F.col("path"), F.col("kind")
    rules = [
        (~F.col("pid").rlike("^[0-9]+$"), "pid"),
        (~kind_of(F.col("operation")).eqNullSafe(kind), "operation of another kind"),
        (kind.isin("file", "exec") & path.isNotNull() & ~path.startswith("/") & ~path.startswith("relative:"), "path neither absolute nor relative"),
        (F.col("end_line") < F.col("line"), "evidence order"),
        ((kind != "spawn") & F.col("child_pid").isNotNull(), "child outside spawn"),
        ((kind == "spawn") & (F.col("outcome") == "success") & F.col("child_pid").isNull(), "spawn without child"),
    ]
    return events.withColumn("error", first_failure(rules)).where("error is not null").select("run_id", "event_index", "error")


def event_facts(events: DataFrame) -> DataFrame:
    """Single-pass facts of each run."""
    failed = (F.col("outcome") != "success") & (F.col("kind") != "exit")
    return events.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("end_line").alias("max_line"), F.bool_or(F.col("end_line") < F.col("line")).alias("bad_order"),
        F.bool_or(F.col("path").isNull() & F.col("kind").isin("file", "exec")).alias("lacks_path"), F.countDistinct("pid").alias("n_pids"),
        F.min(F.when(failed, F.col("event_index"))).alias("first_failure"), F.min_by("operation", F.when(failed, F.col("event_index"))).alias("first_failed_operation"),
    )


def reduce_capture(facts: DataFrame) -> DataFrame:
    """State, completeness and exit projection of a run from its capture facts.

    ``facts``: run_id, recorder_signal, target_code, target_signal, collector_code, limit_hit, n_warnings.
    """
    target = F.coalesce("target_code", F.lit(128) + F.col("target_signal"))
    failed = target.isNull() | F.col("collector_code").isNull() | F.col("limit_hit") | (F.col("collector_code") != target)
    state = F.when(F.col("recorder_signal").isNotNull(), "interrupted").when(failed, "capture_failed").otherwise("completed")
    completeness = F.when(F.col("state") != "completed", "incomplete").when(F.col("n_warnings") == 0, "complete_for_supported_events").otherwise("partial")
    code = F.when(F.col("state") == "interrupted", F.lit(128) + F.col("recorder_signal")).when(F.col("state") == "capture_failed", 125).otherwise(F.coalesce(target, "collector_code", F.lit(125)))
    return facts.withColumn("state", state).select("run_id", "state", completeness.alias("completeness"), code.cast("int").alias("exit_code"))
