"""Whole comparison reports: metadata changes beside observations, reliability, status, text and JSON.

``sides`` has one row per (pair_id, side): the metadata fields as columns, storage,
storage_detail, raw, raw_detail, manifest, the facts of ``records.run_facts``, and for a
side that failed to load load_error and load_kind (else null). All outputs are DataFrames
keyed by pair_id, so a report of one pair and reports of thousands are the same plan;
windows are per pair and see changes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.text import optional, quoted, quoted_list
from runlens.functions.vocab import ALWAYS_SHOWN, CATEGORIES, CWD_NOTE, DETAIL_FAILED, DETAIL_TEMPORARY, FOLDED_NOTE, PATH_NOTE, REPORT_END, UNRELIABLE
from runlens.session import checkpointed

from . import compare, records

c = F.col
SIDES = ("left", "right")


def target_exit(s: Column) -> Column:
    """Explicit code and signal; the raw text only where both are missing."""
    known = F.concat(F.lit("code="), optional(s["exit_code"]), F.lit(", signal="), optional(s["signal"]))
    raw = s["exit_code"].isNull() & s["signal"].isNull() & s["target_exit_raw"].isNotNull()
    return F.when(raw, F.concat(known, F.lit(", raw="), quoted(s["target_exit_raw"]))).otherwise(known)


def n_warnings(s: Column) -> Column:
    return F.greatest(F.coalesce(F.size(s["warnings"]), F.lit(0)), F.lit(0))


def completeness(s: Column) -> Column:
    return F.concat(s["state"], F.lit("; "), F.coalesce(s["completeness"], F.lit("legacy/unknown")), F.lit("; "), n_warnings(s).cast("string"), F.lit(" warnings"))


def paired(sides: DataFrame) -> DataFrame:
    """pair_id, left, right: the side rows as structs, with the error that bars a comparison."""
    sides = sides.withColumn("contract", F.when(c("load_error").isNull(), records.comparison_error()))
    body = F.struct(*[x for x in sides.columns if x not in ("pair_id", "side")])
    rows = sides.groupBy("pair_id").agg(*(F.first(F.when(c("side") == s, body), ignorenulls=True).alias(s) for s in SIDES))
    # After the aggregation, so that the long CASE of the contract is in the plan once.
    for s in SIDES:
        x = c(s)
        error = F.coalesce(x["load_error"], F.concat(F.lit("comparison input contract: "), x["contract"]))
        kind = F.coalesce(x["load_kind"], records.failure_kind(x["contract"], x["storage"]))
        rows = rows.withColumn(s, x.withField("error", error).withField("error_kind", kind))
    return rows


def metadata_changes(pairs: DataFrame) -> DataFrame:
    """Changed run facts in fixed order, then environment keys ascending: pair_id, seq, change, subject, left, right."""
    facts = [("ExitStatus", target_exit), ("InitialWorkingDirectory", lambda s: s["cwd"]), ("CommandArguments", lambda s: quoted_list(s["command"])), ("CaptureCompleteness", completeness)]
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(name).alias("change"), F.lit("").alias("subject"), f(c("left")).alias("before"), f(c("right")).alias("after")) for i, (name, f) in enumerate(facts)])
    plain = pairs.select("pair_id", F.inline(rows)).where(~c("before").eqNullSafe(c("after")))
    env = compare.environment_changes(pairs.select("pair_id", c("left.environment").alias("left"), c("right.environment").alias("right")))
    env = env.select("pair_id", F.lit(len(facts)).alias("seq"), F.lit("SelectedStartupEnvironment").alias("change"), c("name").alias("subject"), "before", "after")
    return plain.union(env).select("pair_id", "seq", "change", "subject", F.array("before").alias("left"), F.array("after").alias("right"))


def header(pairs: DataFrame, forced: int | None = None) -> DataFrame:
    """Per pair: format, names, ids, reliability of both sides, errors, and whether it can be compared.

    Format 5 where a side has metadata 4, else 4, unless 5 or 6 is asked for.
    """
    version = F.lit(forced) if forced else F.when(F.greatest(*(F.coalesce(F.when(c(s)["load_error"].isNull(), c(s)["schema_version"]), F.lit(0)) for s in SIDES)) == 4, 5).otherwise(4)
    rows = pairs.withColumn("format", version)
    for s in SIDES:
        x = c(s)
        bad, new = x["error"].isNotNull(), x["error"].isNull() & x["schema_version"].eqNullSafe(F.lit(4))
        whole = (x["state"] == "completed") & x["completeness"].eqNullSafe(F.lit("complete_for_supported_events"))
        capture = F.when(bad | (x["storage"] == "unfinalized"), "unknown").when(whole, "complete").when(x["completeness"].isNull(), "unknown").otherwise("incomplete")
        storage = F.when(x["error_kind"] == "Corrupt", "corrupt").when(bad, "unavailable").otherwise(x["storage"])
        raw = F.when(new, F.coalesce(x["raw"], F.lit("unverified"))).otherwise("unverified")
        proven = F.when(~new | (x["storage"] == "unfinalized"), "unverified").when(x["target_provenance"].isNotNull(), "verified").otherwise("missing")
        raw_failed = ~bad & x["raw"].isin("corrupt", "unavailable")
        error = F.when(bad, F.concat(F.lit(f"{s}: "), x["error"])).when(raw_failed, F.concat(F.lit(f"{s}: raw evidence: "), x["raw_detail"]))
        quality = F.struct(capture.alias("capture"), storage.alias("storage"), F.when(c("format") > 4, raw).alias("raw"), F.when(c("format") > 4, proven).alias("provenance"))
        rows = rows.withColumn(f"{s}_quality", quality).withColumn(f"{s}_error", error)
    rows = rows.withColumn("errors", F.array_compact(F.array("left_error", "right_error")))
    return rows.withColumn("comparable", F.size("errors") == 0)


def trusted(q: Column) -> Column:
    ok = lambda x: x.isNull() | (x == "verified")
    return (q["capture"] == "complete") & (q["storage"] == "verified") & ok(q["raw"]) & ok(q["provenance"])


def warnings(rows: DataFrame) -> Column:
    """Warnings of a header row: of the new format first, then each side's storage, environment and capture."""
    new, old = [], []
    for s in SIDES:
        x, q = c(s), c(f"{s}_quality")
        say = lambda *parts: F.concat(x["name"], F.lit(": "), *parts)  # noqa: B023, E731
        new.append(F.when((c("format") > 4) & ((q["raw"] != "verified") | (q["provenance"] != "verified")), say(F.lit("trace-v1 raw/provenance requirements are unverified or missing"))))
        clean = (x["state"] == "completed") & (n_warnings(x) == 0) & x["completeness"].eqNullSafe(F.lit("complete_for_supported_events"))
        old += [
            F.when(x["storage"] != "verified", say(x["storage_detail"])),
            F.when(x["environment"].isNull(), say(F.lit("legacy record has no environment selection data"))),
            F.when(~clean, say(F.lit("state="), x["state"], F.lit(", "), n_warnings(x).cast("string"), F.lit(" parser warnings; inspect metadata.json"))),
        ]
    return F.when(c("comparable"), F.array_compact(F.array(*new, *old))).otherwise(F.array().cast("array<string>"))


def visible(good: DataFrame, events: DataFrame) -> DataFrame:
    """Events of the comparable pairs, without those that format 6 withholds."""
    held = good.select("pair_id", *((c(f"{s}.storage") == "unfinalized").alias(f"{s}_held") for s in SIDES), "format")
    hidden = (c("format") == 6) & F.when(c("side") == "left", c("left_held")).otherwise(c("right_held"))
    return events.join(held, "pair_id").where(~hidden).drop("left_held", "right_held", "format")


def changes(heads: DataFrame, events: DataFrame) -> DataFrame:
    """All changes of the comparable pairs, ranked and in presentation order, with evidence samples.

    Events of an unfinalized side are withheld in format 6.
    """
    good = heads.where("comparable")
    meta = metadata_changes(good).select("pair_id", F.lit(0).alias("section"), "seq", *(F.lit("").alias(k) for k in compare.KEY[1:]), "change", "subject", "left", "right")
    seen = visible(good, events)
    found = compare.changes(seen)
    seen_rows = found.select("pair_id", F.lit(1).alias("section"), F.lit(0).alias("seq"), *compare.KEY[1:], "change", F.concat("path", F.lit(" ("), "operation", F.lit(")")).alias("subject"), "left", "right", "rank_class")
    first = F.when(c("change") == "ExitStatus", 0).when(c("change") == "CaptureCompleteness", 1).otherwise(2)
    rows = meta.withColumn("rank_class", first).union(seen_rows)
    pair = Window.partitionBy("pair_id")
    rows = rows.withColumn("comparison_order", F.row_number().over(pair.orderBy("section", "seq", "kind", "operation", "path", "subject")))
    one_sided = (F.size("left") == 0) | (F.size("right") == 0)
    failed = F.forall(F.concat("left", "right"), lambda o: o != "success")
    group = F.when((c("kind") != "file") | ~one_sided, None).when(failed, DETAIL_FAILED).when(compare.temporary(c("path")), DETAIL_TEMPORARY)
    rows = rows.withColumn("detail_group", group).withColumn("priority", F.when(c("detail_group").isNotNull(), 10).otherwise(c("rank_class")))
    rows = rows.withColumn("position", F.row_number().over(pair.orderBy("priority", "comparison_order")))
    samples = compare.evidence_samples(seen).select(*compare.KEY, "side", F.struct("slot", F.struct(F.lit("raw/trace.log").alias("file"), "line", "end_line").alias("e")).alias("s"))
    of = lambda side: F.transform(F.array_sort(F.collect_list(F.when(c("side") == side, c("s")))), lambda x: x["e"])
    samples = samples.groupBy(*compare.KEY).agg(of("left").alias("left_samples"), of("right").alias("right_samples"))
    rows = rows.join(samples, compare.KEY, "left")
    proof = good.select("pair_id", *(F.when((c("format") > 4) & ((c("format") == 5) | (c(f"{s}.storage") == "verified")), c(f"{s}.target_provenance.target_exit.evidence")).alias(f"{s}_proof") for s in SIDES))
    rows = rows.join(proof, "pair_id")
    for s in SIDES:
        exits = F.when((c("change") == "ExitStatus") & c(f"{s}_proof").isNotNull(), F.array(f"{s}_proof"))
        rows = rows.withColumn(f"{s}_evidence", F.coalesce(exits, f"{s}_samples", F.array().cast("array<struct<file:string,line:bigint,end_line:bigint>>")))
    names = F.create_map(*[F.lit(x) for pair_ in CATEGORIES.items() for x in pair_])
    return rows.withColumn("category", names[c("change")]).drop("left_samples", "right_samples", "left_proof", "right_proof", "section", "seq", "priority")


def finished(heads: DataFrame, found: DataFrame) -> DataFrame:
    """Heads with the number of changes, the exit status and the warnings."""
    n = found.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_changes"))
    rows = heads.join(n, "pair_id", "left").withColumn("n_changes", F.coalesce("n_changes", F.lit(0)))
    status = F.when(~c("comparable"), 2).when(~(trusted(c("left_quality")) & trusted(c("right_quality"))), 3).when(c("n_changes") > 0, 1).otherwise(0)
    return rows.withColumn("exit_code", status).withColumn("report_warnings", warnings(rows)).withColumn("observed", F.when(c("comparable"), c("n_changes") > 0))


def text(done: DataFrame, found: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """The report's lines: pair_id, line_no, line."""
    lines = lambda *parts: F.array_compact(F.array(*parts))
    both = lambda label, f: F.concat(F.lit(f"{label}: left="), f("left"), F.lit(", right="), f("right"))
    q = lambda name: lambda s: c(f"{s}_quality")[name]
    top = F.concat(
        lines(
            F.concat(F.lit("Run comparison: "), F.coalesce("left.name", F.lit("")), F.lit(" → "), F.coalesce("right.name", F.lit(""))),
            F.concat(F.lit("Observed differences: "), F.when(c("observed"), "yes").when(~c("observed"), "no").otherwise("not evaluated")),
            both("Capture completeness", q("capture")), both("Storage integrity", q("storage")),
            F.concat(F.lit("Exit code: "), c("exit_code").cast("string")),
            F.when(c("format") > 4, both("Raw evidence integrity", q("raw"))), F.when(c("format") > 4, both("Target provenance", q("provenance"))),
            F.when(c("format") == 6, "Evidence mapping: outcome_event_references_v1; full applicable references in --json"),
            F.when(c("exit_code") == 3, UNRELIABLE),
        ),
        F.transform("errors", lambda e: F.concat(F.lit("ERROR: "), e)),
        lines(F.when(~c("observed"), "No differences in supported, aggregated observations.")),
    )
    total = F.concat(F.lit("Total observed changes: "), c("n_changes").cast("string"), F.lit(" (including folded details)"))
    end = F.concat(F.array(F.lit(""), total), F.transform("report_warnings", lambda w: F.concat(F.lit("warning: "), w)), F.array(F.lit(""), F.lit(REPORT_END)))
    spread = lambda rows, part, position, items: rows.select("pair_id", F.lit(part).alias("part"), position.alias("place"), F.posexplode(items).alias("at", "line"))
    folds = (c("position") > ALWAYS_SHOWN) & c("detail_group").isNotNull()
    shown = found.where(~folds).join(done.select("pair_id", *(c(f"{s}.id").alias(f"{s}_id") for s in SIDES)), "pair_id")
    outcome = lambda s: F.when(F.size(s) == 0, "(not observed)").otherwise(F.array_join(s, ", "))
    evidence = lambda s: F.transform(f"{s}_evidence", lambda e: F.concat(F.lit("  evidence: runs/"), c(f"{s}_id"), F.lit("/"), e["file"], F.lit(":"), e["line"].cast("string"), F.lit("-"), e["end_line"].cast("string")))
    body = F.concat(lines(F.lit(""), c("category"), F.when(c("subject") != "", F.concat(F.lit("  "), "subject")), F.concat(F.lit("  "), outcome("left"), F.lit(" → "), outcome("right"))), evidence("left"), evidence("right"))
    if mapped is not None:
        from .evidence import mapping_lines

        shown = shown.join(mapped, ["pair_id", "position"], "left")
        body = F.concat(body, F.coalesce(mapping_lines(c("evidence_mapping")), F.array().cast("array<string>")))
    folded = found.where(folds).groupBy("pair_id", "detail_group").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.array_sort(F.collect_list("position")), 1, 3), ", ").alias("first"))
    folded = folded.join(done.select("pair_id", "format"), "pair_id").withColumn("place", F.when(c("detail_group") == DETAIL_FAILED, 0).otherwise(1))
    note = lines(F.lit(""), F.concat(F.lit("Detail group: "), "detail_group"), F.concat(F.lit("  "), c("n").cast("string"), F.lit(FOLDED_NOTE + "["), "first", F.lit("]")), F.when(c("format") == 6, "  Folded evidence mappings and all applicable references remain in --json."))
    rows = spread(done, 0, F.lit(0), top).union(spread(shown, 1, c("position"), body)).union(spread(folded, 2, c("place"), note)).union(spread(done, 3, F.lit(0), end))
    order = Window.partitionBy("pair_id").orderBy("part", "place", "at")
    return rows.select("pair_id", F.row_number().over(order).cast("long").alias("line_no"), "line")


def json(done: DataFrame, found: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """One JSON document per pair in the field order of the format: pair_id, value.

    With ``mapped`` (``evidence.evidence_mappings``) the changes of format 6 carry theirs.
    """
    fields = ["category", "subject", "detail_group", "left", "right", "left_evidence", "right_evidence"]
    if mapped is not None:
        found, fields = found.join(mapped, ["pair_id", "position"], "left"), [*fields, "evidence_mapping"]
    item = F.struct("position", F.struct(*fields).alias("change"))
    listed = found.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(item), lambda a, b: a["position"] - b["position"]), lambda x: x["change"]).alias("changes"))
    kind = listed.schema["changes"].dataType
    rows = done.join(listed, "pair_id", "left").withColumn("changes", F.coalesce("changes", F.array().cast(kind)))

    def document(new: bool, contract: bool) -> Column:
        quality = lambda s: F.struct(*(c(f"{s}_quality")[n].alias(n) for n in ("capture", "storage", *(("raw", "provenance") if new else ())))).alias(s)
        known = lambda s, n: F.when(c("comparable"), c(s)[n]).otherwise("")
        fields = [
            c("format").alias("schema_version"), c("observed").alias("observed_differences"), F.struct(quality("left"), quality("right")).alias("reliability"), "exit_code", "errors",
            F.coalesce("left.name", F.lit("")).alias("left"), F.coalesce("right.name", F.lit("")).alias("right"), known("left", "id").alias("left_id"), known("right", "id").alias("right_id"),
            (c("changes") if contract or mapped is None else F.transform("changes", lambda x: x.dropFields("evidence_mapping"))).alias("changes"), c("report_warnings").alias("warnings"),
        ]
        if new:
            fields.append(F.struct(*(F.when(c(s)["error"].isNull(), c(s)["target_provenance"]).alias(s) for s in SIDES)).alias("target_provenance"))
        if contract:
            fields.append(F.lit("outcome_event_references_v1").alias("evidence_contract"))
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    value = F.when(c("format") == 4, document(False, False)).when(c("format") == 5, document(True, False)).otherwise(document(True, True))
    return rows.select("pair_id", value.alias("value"))


def report(sides: DataFrame, events: DataFrame, forced: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Report rows and their changes, each computed once: text and JSON read them several times."""
    heads = checkpointed(header(paired(sides), forced))
    found = checkpointed(changes(heads, events))
    return checkpointed(finished(heads, found)), found


def list_lines(catalogue: DataFrame) -> DataFrame:
    """One tab-separated line per record, in directory order: directory, line.

    ``catalogue``: directory, id, name, completeness, storage, storage_detail, raw, raw_detail.
    """
    told = lambda name, missing: F.coalesce(name, F.lit(missing))
    parts = [told("id", "(no safe ID)"), told("name", "(unknown label)"), c("directory"), F.concat(F.lit("capture="), told("completeness", "unknown")), F.concat(F.lit("storage="), "storage"), c("storage_detail")]
    raw = F.when(c("raw").isNotNull(), F.concat(F.lit("\traw="), "raw", F.lit("\t"), "raw_detail")).otherwise("")
    return catalogue.select("directory", F.concat(F.concat_ws("\t", *parts), raw).alias("line"))


def mapping(events: DataFrame) -> DataFrame:
    """Format 6: per changed key and side each outcome's whole list of event references.

    A list is bounded by the run's event budget.
    """
    rows = compare.comparable(events).join(compare.changes(events).select(*compare.KEY), compare.KEY)
    place = F.struct(c("event_index").alias("index"), F.struct(F.lit("raw/trace.log").alias("file"), "line", "end_line").alias("evidence"))
    return rows.groupBy(*compare.KEY, "side", "outcome").agg(F.count(F.lit(1)).alias("event_count"), F.array_sort(F.collect_list(place)).alias("events"))


def show_lines(runs: DataFrame, events: DataFrame) -> DataFrame:
    """One record as text: run_id, line_no, line.

    ``runs``: run_id, the metadata fields, storage, storage_detail, raw, raw_detail.
    ``events``: run_id, event_index and the saved event's fields, with file, line, end_line.
    """
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    told = lambda name, missing: F.coalesce(c(name), F.lit(missing))
    n = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    rows = runs.join(n, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = c("target_provenance")
    top = [
        join("Storage integrity: ", c("storage"), " — ", c("storage_detail")), join("Raw evidence integrity: ", c("raw"), " — ", c("raw_detail")),
        join("Target provenance: PID ", p["root"]["pid"], " generation ", p["root"]["generation"], "; exec event ", p["root_exec"]["index"], ", exit event ", p["target_exit"]["index"], "; rule ", p["selection_rule"]),
        join(c("name"), " (", c("id"), ")"), join("State: ", c("state"), " / ", told("completeness", "legacy/unknown")), join("Command: ", quoted_list(c("command"))), join("Initial cwd: ", c("cwd")),
        join("Exit: ", optional(c("exit_code")), "; signal: ", optional(c("signal"))), join("Events: ", c("n")),
    ]
    env = F.transform(F.array_sort(F.map_entries("environment")), lambda e: F.concat(F.lit("env "), e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("(unset)"))))
    none = F.array().cast("array<string>")
    head = F.concat(F.array_compact(F.array(*top)), F.coalesce(env, none), F.array(F.lit(PATH_NOTE)))
    placed = c("kind").isin("file", "exec", "cwd")
    doubt = F.coalesce("context_uncertain", F.lit(False)) | c("path").startswith("relative:")
    context = F.when(c("path").isNull(), "unresolved").when(doubt, "uncertain / relative observation").otherwise("recorded absolute spelling; verify syscall evidence")
    one = [
        F.when(placed, join(CWD_NOTE, told("cwd_before", "unknown"))), F.when(placed, join("  Path context: ", context)),
        join(c("pid"), " ", c("operation"), " ", told("path", ""), " => ", c("outcome"), " [runs/", c("id"), "/", c("file"), ":", c("line"), "-", c("end_line"), "]"),
        join("  Trace-local generation: ", c("task_generation"), "; spawned child generation: ", optional(c("child_generation"))),
    ]
    told_events = events.join(runs.select("run_id", "id"), "run_id")
    spread = lambda df, part, place, items: df.select("run_id", F.lit(part).alias("part"), place.cast("long").alias("place"), F.posexplode(items).alias("at", "text"))
    argv = F.array_compact(F.array(join("exec arguments (PID ", c("pid"), "): ", quoted_list(c("argv")))))
    end = F.transform(F.coalesce("warnings", none), lambda w: F.concat(F.lit("warning: "), w))
    lines = spread(rows, 0, F.lit(0), head).union(spread(told_events, 1, c("event_index"), F.array_compact(F.array(*one)))).union(spread(events, 2, c("event_index"), argv)).union(spread(rows, 3, F.lit(0), end))
    order = Window.partitionBy("run_id").orderBy("part", "place", "at")
    return lines.select("run_id", F.row_number().over(order).cast("long").alias("line_no"), c("text").alias("line"))


def recorded_lines(results: DataFrame) -> DataFrame:
    """The summary after a recording: run_id, at, line. ``results``: run_id, name, state, event_count, warnings, evidence_dir."""
    first = F.concat(F.lit("Recorded "), quoted(c("name")), F.lit(": "), "run_id", F.lit(" ("), "state", F.lit(", "), c("event_count").cast("string"), F.lit(" events, "), F.size("warnings").cast("string"), F.lit(" warnings)"))
    items = F.concat(F.array(first, F.concat(F.lit("Evidence: "), "evidence_dir")), F.transform("warnings", lambda w: F.concat(F.lit("warning: "), w)))
    return results.select("run_id", F.posexplode(items).alias("at", "line"))
