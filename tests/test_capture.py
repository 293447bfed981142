"""Decisions about captures by hand: limits, order of warnings, precedence."""

from runlens.operators import capture

FACTS = """run_id string, target_raw string, target_code long, target_signal long, collector string, collector_code long, collector_signal long, collector_reason string,
recorder_signal int, supervision_error string, read_error string, missing array<string>, warnings array<string>, duration_limit_ms long, observed_bytes long, limit_bytes long"""
PLAIN = dict(target_raw="+++ exited with 0 +++", target_code=0, collector="reaped", collector_code=0)


def decided(spark, **facts):
    names = [part.split()[0] for part in FACTS.split(",")]
    row = PLAIN | facts
    return capture.decide(spark.createDataFrame([tuple(row.get(n) for n in names)], FACTS)).first()


def test_plain_run_is_complete(spark):
    row = decided(spark)
    assert (row.state, row.completeness, row.warnings, row.cli_exit) == ("completed", "complete_for_supported_events", [], 0)


def test_interruption_keeps_every_warning_in_order(spark):
    row = decided(
        spark, target_raw="+++ killed by SIGODD +++", target_code=None, collector="failed", collector_code=None, collector_reason="wait failed", recorder_signal=2,
        supervision_error="lost", read_error="gone", missing=["3", "4:2"], warnings=["p"], duration_limit_ms=50, observed_bytes=9, limit_bytes=8,
    )
    assert (row.state, row.completeness, row.cli_exit) == ("interrupted", "incomplete", 130)
    assert [w.split(" ")[0] for w in row.warnings] == ["p", "cannot", "unrecognized", "process", "wait", "capture", "capture", "lost"]
    assert row.warnings[5:7] == ["capture duration limit exceeded (limit: 50 ms)", "capture trace byte limit exceeded (observed: 9 bytes, limit: 8 bytes)"]
    assert row.warnings[3].endswith(": 3, 4:2") and row.collector_exit_code is None


def test_outcomes(spark):
    other = decided(spark, collector_code=1)
    assert (other.state, other.cli_exit, other.exit_code, len(other.warnings)) == ("capture_failed", 125, 0, 1)
    signal = decided(spark, target_raw="+++ killed by SIGKILL +++", target_code=None, target_signal=9, collector_code=None, collector_signal=9)
    assert (signal.state, signal.cli_exit, signal.exit_code, signal.signal, signal.warnings) == ("completed", 137, None, 9, [])
    unknown = decided(spark, target_raw="+++ killed by SIGODD +++", target_code=None, collector_code=4)
    assert (unknown.state, unknown.completeness, unknown.cli_exit) == ("completed", "partial", 4)
    none = decided(spark, target_raw=None)
    assert (none.state, none.exit_code, none.cli_exit, len(none.warnings)) == ("capture_failed", None, 125, 1)


def test_limits_are_strict_and_latched(spark):
    rows = [("a", 1, "bytes", 5, 5), ("a", 2, "bytes", 6, 5), ("a", 3, "bytes", 9, 5), ("a", 4, "bytes", 2, 5), ("a", 5, "duration", None, 70), ("a", 6, "duration", None, 80), ("b", 1, "bytes", 5, 5)]
    facts = capture.limit_facts(spark.createDataFrame(rows, "run_id string, seq long, kind string, observed long, limit long"))
    found = {r.run_id: tuple(r)[1:] for r in facts.collect()}
    assert found == {"a": (70, 9, 5, 2), "b": (None, None, None, None)}


def test_admission(spark):
    rows = spark.createDataFrame([(1, True, 5), (2, False, 5), (3, False, None)], "i long, unverified boolean, limit_bytes long")
    from pyspark.sql import functions as F

    found = rows.select("i", capture.admission(F.col("unverified")).alias("a")).orderBy("i").collect()
    assert [r.a for r in found] == ["suppressed_length_unverified", "suppressed_byte_limit", "parse"]
