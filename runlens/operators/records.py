"""Contracts of saved runs: metadata, provenance, raw receipts, events against metadata, comparison inputs.

Each contract is a list of (condition, message); the first condition that holds gives the
error, and a list is one CASE column, so thousands of runs are checked in one projection.
Inputs carry the metadata fields of ``sources.trace.METADATA`` as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.decode import exit_fields, is_exit_spelling, kind_of
from runlens.functions.vocab import IDENTITY_CONTRACT, SELECTION_RULE

from .contracts import first_failure

Rules = list[tuple[Column, str]]
c = F.col
CONTROL = "[\\x00-\\x1f\\x7f-\\x9f]"


def yes(condition: Column) -> Column:
    """An unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False))


def no(condition: Column) -> Column:
    return ~yes(condition)


def blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) == ""


def outside(value: Column, low: int, high: int) -> Column:
    return value.isNotNull() & ~value.between(low, high)


def positive_pid(value: Column) -> Column:
    return yes(value.rlike("^[0-9]+$") & value.try_cast("bigint").between(1, 4294967295))


def record_id(value: Column) -> Column:
    """Time in hexadecimal (at most 128 bits), a dash, a positive process number."""
    return yes(value.rlike("^0*[0-9a-fA-F]{1,32}-[0-9]+$") & positive_pid(F.substring_index(value, "-", -1)))


def provenance_rules() -> Rules:
    p = c("target_provenance")
    references = [p["root_exec"], p["target_exit"]]
    beyond = lambda r: (r["index"] >= c("parsed_events")) | (r["evidence"]["file"] != "raw/trace.log") | (r["evidence"]["line"] == 0) | (r["evidence"]["line"] > r["evidence"]["end_line"]) | (r["evidence"]["end_line"] > c("raw_lines"))
    place = lambda r: F.struct(r["evidence"]["line"], r["evidence"]["end_line"], r["index"])
    has = p.isNotNull()
    return [
        (has & no((p["schema_version"] == 1) & (p["selection_rule"] == SELECTION_RULE) & (p["identity_contract"] == IDENTITY_CONTRACT)), "unsupported target provenance or identity contract"),
        (has & (no(p["root"]["generation"] > 0) | ~positive_pid(p["root"]["pid"])), "target provenance requires a positive numeric task lifetime"),
        (has & (beyond(references[0]) | beyond(references[1])), "target provenance references exceed saved event or evidence bounds"),
        (has & ((references[0]["index"] == references[1]["index"]) | (place(references[0]) >= place(references[1]))), "target exit must follow a distinct selected exec reference"),
    ]


def metadata_rules() -> Rules:
    """The metadata contract. Versions 1 and 2 keep free-form fields and only exclude double outcomes."""
    version, raw = c("schema_version"), c("target_exit_raw")
    new, current = version == 4, version >= 3
    saved = exit_fields(raw)
    contradicts = ~(saved["code"].eqNullSafe(c("exit_code")) & saved["signal"].eqNullSafe(c("signal")))
    state, done = c("state"), c("completeness")
    target, collector = c("exit_code").isNotNull() | c("signal").isNotNull(), c("collector_exit_code").isNotNull() | c("collector_signal").isNotNull()
    warned = F.coalesce(F.size("warnings"), F.lit(0)) > 0
    finals = c("ended").isNotNull() | target | collector | raw.isNotNull() | warned | (c("parsed_events") != 0) | (c("raw_lines") != 0)
    confirmed = (c("exit_code").isNotNull() != c("signal").isNotNull()) & c("collector_exit_code").eqNullSafe(c("exit_code")) & c("collector_signal").eqNullSafe(c("signal"))
    full = done == "complete_for_supported_events"
    bad_key = F.exists(F.map_keys("environment"), lambda k: (k == "") | k.contains("=") | k.rlike(CONTROL))
    rules = [
        (new & no(c("evidence_contract") == "trace-v1"), "metadata4 requires evidence contract trace-v1"),
        (new & (raw.isNotNull() != c("target_provenance").isNotNull()), "trace-v1 target outcome and provenance must occur together"),
        (new & raw.isNotNull() & ~is_exit_spelling(raw), "invalid trace-v1 completion framing"),
        (new & raw.isNotNull() & contradicts, "trace-v1 numeric target outcome contradicts its saved exit spelling"),
        *((new & when, text) for when, text in provenance_rules()),
        (~new & (c("evidence_contract").isNotNull() | c("target_provenance").isNotNull()), "historical metadata cannot claim trace-v1 facts"),
        (c("exit_code").isNotNull() & c("signal").isNotNull(), "target exit code and signal are mutually exclusive"),
        (c("collector_exit_code").isNotNull() & c("collector_signal").isNotNull(), "collector exit code and signal are mutually exclusive"),
    ]
    later = [
        (outside(c("exit_code"), 0, 255), "current exit code must be in 0..=255"),
        (outside(c("signal"), 1, 64), "current Linux signal must be in 1..=64"),
        (outside(c("collector_exit_code"), 0, 255), "current exit code must be in 0..=255"),
        (outside(c("collector_signal"), 1, 64), "current Linux signal must be in 1..=64"),
        (~record_id(c("id")), "ID is not one safe generated component"),
        (blank(c("name")) | c("name").rlike(CONTROL), "name must be nonempty without control characters"),
        (F.coalesce(F.size("command"), F.lit(0)) < 1, "command must contain an executable"),
        (blank(c("tool_version")) | blank(c("cwd")) | blank(c("backend")), "tool version, cwd and backend must be nonempty"),
        (c("environment").isNull(), "environment is missing"),
        (yes(bad_key), "environment keys must be nonempty without '=' or control characters"),
        (no(state.isin("running", "completed", "capture_failed", "interrupted")), "unknown capture state"),
        (done.isNull(), "completeness is missing"),
        (~done.isin("pending", "complete_for_supported_events", "partial", "incomplete"), "unknown capture completeness"),
        ((state == "completed") & ~done.isin("complete_for_supported_events", "partial"), "completed metadata must be complete or partial"),
        (state.isin("capture_failed", "interrupted") & (done != "incomplete"), "failed or interrupted capture must be incomplete"),
        ((state == "running") & (done != "pending"), "running metadata must be pending"),
        ((state == "running") & finals, "running metadata contains finalized capture facts"),
        ((state == "completed") & c("ended").isNull(), "completed metadata has no end time"),
        ((state == "completed") & (done == "partial") & ~warned, "partial metadata records no evidence limitation"),
        ((state == "completed") & raw.isNull(), "completed metadata has no raw target outcome"),
        ((state == "completed") & ~collector, "completed metadata has no collector outcome"),
        (state.isin("capture_failed", "interrupted") & c("ended").isNull(), "final metadata has no end time"),
        ((state == "capture_failed") & ~warned, "failed capture records no failure warning"),
        (full & warned, "complete metadata cannot contain capture limitations"),
        (target & raw.isNull(), "structured target outcome has no raw target outcome"),
        ((full | ((state == "completed") & target)) & ~confirmed, "completed metadata lacks a confirmed target outcome"),
    ]
    return rules + [(current & when, text) for when, text in later]


def event_rules() -> Rules:
    """The contract of one current event, with evidence coordinates as columns file, line, end_line."""
    kind, path, version = c("kind"), c("path"), c("schema_version")
    located, uncertain = kind.isin("file", "exec", "cwd"), F.coalesce("context_uncertain", F.lit(False))
    relative = path.startswith("relative:") & uncertain
    nowhere = (kind == "cwd") & path.isNull() & uncertain
    child = c("child_pid")
    claims = c("task_generation").isNotNull() | c("child_generation").isNotNull()
    annotated = (c("task_generation") > 0) & (c("child_generation").isNull() | (c("child_generation") > 0)) & (child.isNotNull() == c("child_generation").isNotNull())
    kept = positive_pid(child) & path.eqNullSafe(child)
    return [
        (no(version.isin(2, 3)), "current event must use schema 2 or 3"),
        ((version == 2) & claims, "event2 cannot claim persistent generation annotations"),
        ((version == 3) & no(annotated), "event3 requires positive actor and observed-child generations"),
        (~positive_pid(c("pid")), "event PID must be a positive numeric task ID"),
        (blank(c("operation")) | blank(c("outcome")), "event operation and outcome must be nonempty"),
        ((version == 3) & (kind == "exit") & ~is_exit_spelling(c("outcome")), "event3 exit requires trace-v1 completion framing"),
        (no(kind_of(c("operation")) == kind), "event operation contradicts its current family"),
        (kind.isin("file", "exec") & blank(path), "file and exec events require a nonempty observed path"),
        (located & no(path.startswith("/") | relative | nowhere), "unresolved current path requires explicit relative context and uncertainty"),
        (no((c("file") == "raw/trace.log") & (c("line") > 0) & (c("line") <= c("end_line"))), "current event must retain ordered raw/trace.log evidence coordinates"),
        ((kind != "exec") & c("argv").isNotNull(), "only exec events may carry argv"),
        ((kind != "spawn") & child.isNotNull(), "only spawn events may carry a child PID"),
        ((kind == "spawn") & (c("outcome") == "success") & ~kept, "successful spawn must retain the same positive child PID and result path"),
        ((kind == "spawn") & (c("outcome") != "success") & child.isNotNull(), "failed spawn must not claim a child PID"),
        (kind.isin("context", "exit") & path.isNotNull(), "context and exit event shapes contradict their family"),
    ]


def run_facts(events: DataFrame) -> DataFrame:
    """One row per run from its saved events, in one aggregation with map-side partial results."""
    version, path = c("schema_version"), c("path")
    no_argv = (c("kind") == "exec") & c("argv").isNull()
    unplaced = c("kind").isin("file", "exec", "cwd") & no(path.startswith("/"))
    rows = events.withColumn("_error", first_failure(event_rules()))
    at = lambda when: F.when(when, c("event_index"))
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min_by("schema_version", at(no(version.between(1, 3)))).alias("unsupported_schema"),
        F.bool_or(no(version == 2)).alias("has_non_v2"), F.bool_or(no(version == 3)).alias("has_non_v3"), F.bool_or(yes(version == 3)).alias("has_v3"),
        F.bool_or(no((c("line") > 0) & (c("line") <= c("end_line")))).alias("bad_order"), F.max("end_line").alias("max_line"),
        F.bool_or(F.coalesce("context_uncertain", F.lit(False))).alias("any_uncertain"),
        F.min_by("_error", at(c("_error").isNotNull())).alias("shape_error"),
        F.bool_or(no_argv).alias("argv_missing"), F.bool_or(no_argv | unplaced).alias("incomplete"),
    )


def run_rules(finalized: Column) -> Rules:
    """Metadata and the facts of its events together; a run without events has null facts."""
    version, count = c("schema_version"), F.coalesce("n_events", F.lit(0))
    full = c("completeness") == "complete_for_supported_events"
    return [
        *metadata_rules(),
        ((version >= 3) & finalized & (c("state") == "running"), "finalization marker contradicts running metadata"),
        ((version == 3) & c("has_non_v2"), "current metadata schema requires only event schema 2"),
        (((version == 4) & c("has_non_v3")) | ((version < 3) & c("has_v3")), "metadata/event version tuple is inconsistent"),
        (no(c("parsed_events") == count), "metadata parsed event count does not match events"),
        (c("bad_order") | (c("max_line") > c("raw_lines")), "event evidence lines fall outside the recorded raw trace"),
        ((version >= 3) & full & c("any_uncertain") & c("shape_error").isNull(), "complete metadata contains context-uncertain evidence"),
        ((version >= 3) & full & c("argv_missing") & c("shape_error").isNull(), "complete metadata contains exec evidence without decoded argv"),
        ((version >= 3) & full & c("incomplete") & c("shape_error").isNull(), "complete metadata contains missing or nonabsolute path evidence"),
    ]


def shape_message() -> Column:
    return F.when((c("schema_version") >= 3) & c("shape_error").isNotNull(), F.concat(F.lit("current event shape: "), c("shape_error")))


def run_error(finalized: Column) -> Column:
    return F.coalesce(first_failure(run_rules(finalized)), shape_message())


def receipt_rules() -> Rules:
    """The raw manifest (column ``manifest``: schema_version, run_id, file, receipt) against its metadata."""
    m, r = c("manifest"), c("manifest.receipt")
    has, parsed = m.isNotNull(), r["status"] == "parsed"
    empty = (r["bytes"] == 0) != (r["logical_lines"] == 0)
    claims = blank(r["reason"]) | c("target_provenance").isNotNull() | (c("parsed_events") != 0) | (c("raw_lines") != 0) | no(c("completeness") == "incomplete")
    return [
        (has & no(m["schema_version"] == 1), "unsupported raw manifest version"),
        (has & no((c("schema_version") == 4) & (m["run_id"] == c("id")) & (m["file"] == "raw/trace.log")), "raw manifest identity or metadata tuple mismatch"),
        (has & parsed & no(r["sha256"].rlike("^[0-9a-f]{64}$")), "raw receipt SHA-256 must be lower-case hexadecimal"),
        (has & parsed & (no(r["logical_lines"] == c("raw_lines")) | empty | (r["logical_lines"] > r["bytes"])), "raw receipt byte/line counts contradict metadata"),
        (has & (r["status"] == "unverified") & claims, "unverified raw input cannot supply parsed target evidence"),
    ]


def comparison_error() -> Column:
    """Why a loaded run can't be compared, or null. Adds storage, raw and manifest to the run's columns."""
    storage, version, raw = c("storage"), c("schema_version"), c("raw")
    withheld = (storage == "unfinalized") & (F.coalesce("n_events", F.lit(0)) == 0) & ((version >= 3) | (c("state") == "running"))
    receipt = c("manifest.receipt.status")
    consistent = (
        F.when(storage == "unfinalized", (raw == "unverified") & c("manifest").isNull() & (F.coalesce("n_events", F.lit(0)) == 0))
        .when(storage == "verified", F.when(receipt == "parsed", raw.isin("verified", "corrupt", "unavailable")).when(receipt == "unverified", raw == "unverified"))
        .otherwise(False)
    )
    early: Rules = [
        (no(storage.isin("verified", "unverified", "unfinalized")), "failed or unknown storage integrity cannot be a loaded comparison input"),
        (no(version.between(1, 4)) | c("unsupported_schema").isNotNull(), "unsupported metadata or event schema in comparison input"),
        ((version >= 2) & (c("environment").isNull() | c("completeness").isNull()), "metadata: missing environment or completeness"),
        *metadata_rules(),
        ((version == 4) & raw.isNull(), "trace-v1 run lacks independent raw integrity"),
        ((version == 4) & ~raw.isin("verified", "unverified", "corrupt", "unavailable"), "unknown raw integrity classification"),
        *(((version == 4) & when, text) for when, text in receipt_rules()),
        ((version == 4) & no(consistent), "raw component facts contradict structured finalization or receipt"),
        ((version != 4) & raw.isNotNull(), "historical record cannot claim new raw integrity"),
    ]
    last = F.when((storage == "verified") & (no(version.isin(3, 4)) | (c("state") == "running")), "verified comparison requires current finalized metadata")
    return F.coalesce(first_failure(early), F.when(~withheld, F.coalesce(run_error(storage == "verified"), last)))


def failure_kind(error: Column, storage: Column) -> Column:
    """Unsupported versions and unavailable records are told from damage."""
    by_storage = F.when(storage == "unsupported", "Unsupported").when(storage == "unavailable", "Unavailable")
    return F.when(error.isNotNull(), F.coalesce(by_storage, F.when(error.startswith("unsupported"), "Unsupported").otherwise("Corrupt")))


def schema_tuple_error(marker: Column) -> Column:
    """Which metadata, event and marker versions may occur together."""
    version = c("schema_version")
    return F.coalesce(
        F.when(~version.between(1, 4), F.concat(F.lit("unsupported metadata schema "), version)),
        F.when(~marker.isin(1, 2), F.concat(F.lit("unsupported finalization marker schema "), marker)),
        F.when(c("unsupported_schema").isNotNull(), F.concat(F.lit("unsupported event schema "), c("unsupported_schema"))),
        first_failure([
            ((version == 3) & c("has_non_v2"), "current metadata schema requires only event schema 2"),
            ((version == 4) & c("has_non_v3"), "trace-v1 metadata requires only event schema 3"),
            ((version <= 3) & c("has_v3"), "legacy metadata cannot adopt trace-v1 event schema 3"),
            (marker.isNotNull() & ((version == 4) != (marker == 2)), "metadata and finalization marker versions contradict"),
        ]),
    )
