"""From facts about a capture to its decision: limits, admission of the log, state, warnings, exit.

Facts of a run are columns: ``target_raw`` (null: no target seen), ``target_code``, ``target_signal``
(both null: an outcome not understood), ``collector`` (reaped, not_started or failed), ``collector_code``,
``collector_signal``, ``collector_reason``, ``recorder_signal``, ``supervision_error``, ``read_error``,
``missing`` and ``warnings`` (arrays of strings; null: none), and the limit facts of ``limit_facts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.vocab import CAPTURE_WARNINGS

c = F.col


def over_limit(observed: Column, limit: Column) -> Column:
    """A limit is crossed only beyond it."""
    return observed > limit


def limit_facts(observations: DataFrame) -> DataFrame:
    """Crossed limits of each run: the first duration limit and the last byte length beyond its limit.

    ``observations``: run_id, seq, kind (duration or bytes), observed, limit. Equal seqs are told
    apart by their figures. ``first_excess`` is the seq at which bytes first crossed.
    """
    beyond = (c("kind") == "bytes") & over_limit(c("observed"), c("limit"))
    rows = observations.groupBy("run_id").agg(
        F.min(F.when(c("kind") == "duration", F.struct("seq", "limit"))).alias("_first"),
        F.max(F.when(beyond, F.struct("seq", "observed", "limit"))).alias("_last"),
        F.min(F.when(beyond, c("seq"))).alias("first_excess"),
    )
    return rows.select("run_id", c("_first.limit").alias("duration_limit_ms"), c("_last.observed").alias("observed_bytes"), c("_last.limit").alias("limit_bytes"), "first_excess")


def admission(length_unverified: Column) -> Column:
    """Whether the log is parsed. A length that was once unverified stays so; duration alone suppresses nothing."""
    return F.when(length_unverified, "suppressed_length_unverified").when(c("limit_bytes").isNotNull(), "suppressed_byte_limit").otherwise("parse")


def _warnings(target_unknown: Column, unconfirmed: Column, reaped: Column) -> Column:
    """All warnings of a run in their fixed order."""
    w, none = CAPTURE_WARNINGS, F.array().cast("array<string>")
    given = lambda name: F.coalesce(c(name), none)
    numbers = lambda name, *columns: F.format_string(w[name], *columns)
    found = F.array(
        F.when(c("read_error").isNotNull(), F.concat(F.lit(w["read"]), c("read_error"))),
        F.when(c("target_raw").startswith("+++ killed by ") & target_unknown, w["signal"]),
        F.when(F.size(given("missing")) > 0, F.concat(F.lit(w["missing"]), F.array_join("missing", ", "))),
        F.when(c("target_raw").isNull(), w["root"]),
        F.when(~reaped, c("collector_reason")).when(unconfirmed, w["collector"]),
        F.when(c("duration_limit_ms").isNotNull(), numbers("duration", c("duration_limit_ms"))),
        F.when(c("limit_bytes").isNotNull(), numbers("bytes", c("observed_bytes"), c("limit_bytes"))),
        c("supervision_error"),
    )
    return F.concat(given("warnings"), F.array_compact(found))


def decide(facts: DataFrame) -> DataFrame:
    """State, completeness, ordered warnings, shell exit and the metadata's outcome columns of each run.

    A recorder's signal decides the state and the exit, but takes no warning away. Target and
    collector keep a code or a signal, never both; a collector that wasn't reaped has neither.
    """
    seen, reaped = c("target_raw").isNotNull(), F.coalesce(c("collector") == "reaped", F.lit(False))
    target_code = F.when(seen, c("target_code"))
    target_signal = F.when(seen & c("target_code").isNull(), c("target_signal"))
    collector_code = F.when(reaped, c("collector_code"))
    collector_signal = F.when(reaped & c("collector_code").isNull(), c("collector_signal"))
    target_unknown = target_code.isNull() & target_signal.isNull()
    collector_unknown = collector_code.isNull() & collector_signal.isNull()
    same = collector_code.eqNullSafe(target_code) & collector_signal.eqNullSafe(target_signal)
    unconfirmed = collector_unknown | (~target_unknown & ~same)
    limited = c("duration_limit_ms").isNotNull() | c("limit_bytes").isNotNull()
    failed = ~seen | ~reaped | unconfirmed | limited | c("supervision_error").isNotNull()
    rows = facts.select(
        "run_id", "recorder_signal", F.when(c("recorder_signal").isNotNull(), "interrupted").when(failed, "capture_failed").otherwise("completed").alias("state"),
        _warnings(target_unknown, unconfirmed, reaped).alias("warnings"), target_code.alias("exit_code"), target_signal.alias("signal"),
        collector_code.alias("collector_exit_code"), collector_signal.alias("collector_signal"), c("target_raw").alias("target_exit_raw"),
    )
    clean = F.when(F.size("warnings") == 0, "complete_for_supported_events").otherwise("partial")
    own = F.coalesce(c("exit_code"), c("signal") + 128, c("collector_exit_code"), c("collector_signal") + 128, F.lit(125))
    shell = F.when(c("state") == "interrupted", c("recorder_signal") + 128).when(c("state") == "capture_failed", 125).otherwise(own)
    return rows.withColumns({"completeness": F.when(c("state") == "completed", clean).otherwise("incomplete"), "cli_exit": shell.cast("int")}).drop("recorder_signal")
