"""Sources of recorded runs: raw traces, event files, metadata, the catalogue.

Whole files are read as binary rows, because line numbers and byte checks are part of
the data. Files above their limit and files that aren't UTF-8 are refused whole, never read
in part: they give one row with ``error`` and their size, and no lines. Folders without a
file give no row of that file; a root without ``runs`` has no records.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import decode
from runlens.operators import records
from runlens.operators.contracts import first_failure
from runlens.operators.parse import Parsed, parse
from runlens.operators.provenance import provenance_errors

MAX_WHOLE = 256 << 20
#: Limits of a file by name, of one line, and of the JSON values of one document.
LIMITS = {"metadata.json": 8 << 20, "finalized.json": 64 << 10, "raw-integrity.json": 64 << 10}
MAX_LINE = 8 << 20
MAX_JSON_VALUES = 65_536
DOCUMENT = "run_id string, content binary, bytes bigint, sha256 string, is_utf8 boolean, error string"

EVIDENCE = T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.LongType()), T.StructField("end_line", T.LongType())])
EVENT = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("pid", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("operation", T.StringType()), T.StructField("path", T.StringType()), T.StructField("outcome", T.StringType()),
    T.StructField("evidence", EVIDENCE), T.StructField("argv", T.ArrayType(T.StringType())), T.StructField("child_pid", T.StringType()),
    T.StructField("cwd_before", T.StringType()), T.StructField("context_uncertain", T.BooleanType()),
    T.StructField("task_generation", T.LongType()), T.StructField("child_generation", T.LongType()),
])
REFERENCE = T.StructType([T.StructField("index", T.LongType()), T.StructField("evidence", EVIDENCE)])
PROVENANCE = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("selection_rule", T.StringType()), T.StructField("identity_contract", T.StringType()),
    T.StructField("root", T.StructType([T.StructField("pid", T.StringType()), T.StructField("generation", T.LongType())])),
    T.StructField("root_exec", REFERENCE), T.StructField("target_exit", REFERENCE),
])
METADATA = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("tool_version", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("command", T.ArrayType(T.StringType())), T.StructField("cwd", T.StringType()),
    T.StructField("started", T.LongType()), T.StructField("ended", T.LongType()), T.StructField("backend", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("exit_code", T.IntegerType()), T.StructField("signal", T.IntegerType()),
    T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("parsed_events", T.LongType()), T.StructField("raw_lines", T.LongType()),
    T.StructField("environment", T.MapType(T.StringType(), T.StringType())), T.StructField("completeness", T.StringType()),
    T.StructField("collector_exit_code", T.IntegerType()), T.StructField("collector_signal", T.IntegerType()), T.StructField("target_exit_raw", T.StringType()),
    T.StructField("evidence_contract", T.StringType()), T.StructField("target_provenance", PROVENANCE),
])


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path: any store that Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, root: str) -> DataFrame:
    """run_id of every record folder, also of empty ones: a listing of names."""
    fs, where = _folder(spark, f"{root}/runs")
    names = [(s.getPath().getName(),) for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []
    return spark.createDataFrame(names, "run_id string")


def json_values(content: Column) -> Column:
    """Strings, containers and scalars of a JSON text: what decoding it would allocate."""
    return F.regexp_count(content, F.lit(r'(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)|[\[{]|[^\[\]{},:" \n\r\t]+'))


def documents(spark: SparkSession, root: str, name: str, limit: int | None = None) -> DataFrame:
    """run_id, content, bytes, sha256, is_utf8, error of ``runs/*/name``; content is null where error isn't."""
    fs, where = _folder(spark, f"{root}/runs")
    if not fs.exists(where):
        return spark.createDataFrame([], DOCUMENT)
    limit = limit or LIMITS.get(name, MAX_WHOLE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name.rsplit("/", 1)[-1]).load(f"{root}/runs")
    run = F.regexp_extract("path", f"/runs/([^/]+)/{name.replace('.', '[.]')}$", 1)
    files = files.select(run.alias("run_id"), "content", "length").where("run_id <> ''")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    read = files.where(F.col("length") <= limit).select("run_id", F.when(valid, F.col("content")).alias("content"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), valid.alias("is_utf8"), F.when(~valid, "not UTF-8").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    over = files.where(F.col("length") > limit).select("run_id", none("binary"), F.col("length"), none("string"), none("boolean"), F.lit(f"resource limit of {limit} bytes"))
    return read.union(over).union(_empty(spark, fs, root, name))


def _empty(spark: SparkSession, fs, root: str, name: str) -> DataFrame:
    """Rows of empty files, which Spark's readers leave out: a listing of names and lengths."""
    found = [s for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/runs/*/{name}")) or () if s.getLen() == 0]
    depth = name.count("/") + 1
    runs_ = [s.getPath().toString().rsplit("/", depth + 1)[1] for s in found]
    return spark.createDataFrame([(r, b"", 0, hashlib.sha256(b"").hexdigest(), True, None) for r in runs_], DOCUMENT)


def refused(docs: DataFrame) -> DataFrame:
    """run_id, error, bytes of the documents that weren't read."""
    return docs.where("error is not null").select("run_id", "error", "bytes")


def lines(docs: DataFrame) -> DataFrame:
    """One row per line with its 1-based number; an unterminated last line keeps its flag.

    A line over the limit keeps its number and has no text; a refused document is one row without number.
    """
    text = F.col("content").cast("string")
    parts = F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(F.split(text, "\n"), 1, F.size(F.split(text, "\n")) - 1)).otherwise(F.split(text, "\n"))
    rows = docs.where("error is null").select("run_id", F.posexplode(parts).alias("at", "raw"), text.endswith("\n").alias("_ended"), F.size(parts).alias("_n"))
    ended = F.col("_ended") | (F.col("at") + 1 < F.col("_n"))
    long = F.octet_length("raw") + 1 > MAX_LINE
    rows = rows.select("run_id", (F.col("at") + 1).cast("long").alias("line"), F.when(~long, F.when(ended, decode.framed(F.col("raw"))).otherwise(F.col("raw"))).alias("text"), ended.alias("terminated"), F.when(long, f"resource limit of {MAX_LINE} bytes").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.union(docs.where("error is not null").select("run_id", none("bigint"), none("string"), none("boolean"), "error"))


def raw_observations(spark: SparkSession, root: str) -> DataFrame:
    """Decoded raw lines: run_id, line, pid, body, t (line kind), op; refused logs and lines with their error."""
    rows = lines(documents(spark, root, "raw/trace.log")).withColumn("p", decode.line_parts(F.col("text")))
    rows = rows.select("run_id", "line", "terminated", "p.pid", "p.body", "error")
    return rows.withColumn("t", decode.line_kind(F.col("body"))).withColumn("op", decode.operation(F.col("body")))


def parsed(spark: SparkSession, root: str, initial_cwd: str | None = None) -> Parsed:
    """Events and warnings of all raw logs; a refused log gives one warning and nothing else."""
    rows = lines(documents(spark, root, "raw/trace.log"))
    out = parse(rows.where("error is null").drop("error"), initial_cwd)
    told = rows.where("error is not null").select("run_id", F.lit(-1).alias("phase"), F.coalesce("line", F.lit(0)).alias("place"), F.lit(0).alias("step"), F.concat(F.lit("raw/trace.log: "), "error").alias("text"))
    return Parsed(out.events, out.warnings.unionByName(told))


def events(spark: SparkSession, root: str) -> DataFrame:
    """Saved events with their position; undecodable lines come with a null event, refused files with their error."""
    rows = lines(documents(spark, root, "events.jsonl"))
    return rows.select("run_id", (F.col("line") - 1).alias("event_index"), F.from_json("text", EVENT, {"mode": "PERMISSIVE"}).alias("event"), "terminated", "error")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all runs."""
    rows = documents(spark, root, "metadata.json")
    return rows.select("run_id", "bytes", "sha256", F.from_json(F.col("content").cast("string"), METADATA).alias("metadata"))


def files(spark: SparkSession, root: str) -> DataFrame:
    """One row per record folder with its files (structs, null where missing) and the facts of its event lines."""
    out = folders(spark, root)
    for name, column in (("finalized.json", "marker"), ("metadata.json", "metadata"), ("events.jsonl", "events"), ("raw-integrity.json", "manifest"), ("raw/trace.log", "raw")):
        rows = documents(spark, root, name)
        out = out.join(rows.select("run_id", F.struct(*(c for c in rows.columns if c != "run_id")).alias(column)), "run_id", "left")
    return out.join(line_facts(events(spark, root)), "run_id", "left")


def line_facts(rows: DataFrame) -> DataFrame:
    """Per run of :func:`events`: lines, the first that is no event, whether the last is terminated."""
    at = F.when(F.col("event").isNull() | F.col("event.pid").isNull(), F.col("event_index"))
    return rows.where("event_index is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min(at).alias("first_bad"), F.bool_and("terminated").alias("ended"))


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """All record folders in byte order, with their storage and raw status; damaged ones keep what their metadata tells."""
    rows = loaded(files(spark, root))
    return rows.select("run_id", "record.name", "record.state", "record.completeness", "storage", "detail", "raw_status").orderBy("run_id")


FILE_CHECK = "struct<bytes:bigint,sha256:string>"
MARKER = f"schema_version int, run_id string, event_count bigint, events {FILE_CHECK}, metadata {FILE_CHECK}, raw_manifest {FILE_CHECK}"
MANIFEST = "schema_version int, run_id string, file string, receipt struct<status:string,bytes:bigint,logical_lines:bigint,sha256:string,reason:string>"


def _check(column: str, name: str, expected: Column) -> list:
    """A bound file: present, within its limit, and the bytes that the marker promises."""
    file, known = F.col(column), F.col(f"{column}.bytes").isNotNull()
    same = (F.col(f"{column}.bytes") == expected["bytes"]) & (F.col(f"{column}.sha256") == expected["sha256"])
    return [
        (file.isNull(), "corrupt", f"{name}: missing"),
        (known & F.col(f"{column}.sha256").isNull(), "unavailable", f"{name}: over its size limit"),
        (~F.coalesce(same, F.lit(False)), "corrupt", f"{name}: byte count or SHA-256 mismatch"),
    ]


def loaded(rows: DataFrame) -> DataFrame:
    """The load decision of each row of :func:`files`: run_id, record (metadata), storage, detail, raw_status, raw_detail.

    The marker comes first and all bytes it binds are checked before any of them is read as
    data, so damage outranks versions; without a marker current and running records are
    unfinalized, older ones unverified. The raw log is judged by its receipt alone and can't
    undo what the other files proved.
    """
    text = lambda column: F.col(f"{column}.content").cast("string")
    rows = rows.withColumn("m", F.from_json(text("marker"), MARKER)).withColumn("record", F.from_json(text("metadata"), METADATA)).withColumn("r", F.from_json(text("manifest"), MANIFEST))
    has, m, r, version = F.col("marker").isNotNull(), F.col("m"), F.col("r"), F.col("record.schema_version")
    many = json_values(text("metadata")) > MAX_JSON_VALUES
    decoded = [
        (F.col("metadata.error").isNotNull(), "corrupt", "metadata.json: not UTF-8"),
        (many, "unavailable", "metadata.json: too many JSON values"),
        (version.isNull() | F.col("record.id").isNull(), "corrupt", "metadata.json: not a metadata document"),
        (~version.between(1, 4), "unsupported", "unsupported metadata schema"),
        (F.col("record.id") != F.col("run_id"), "corrupt", "metadata ID does not match its directory"),
    ]
    lines_ = [
        (~F.coalesce("ended", F.lit(True)), "corrupt", "events.jsonl: incomplete final line"),
        (F.col("first_bad").isNotNull(), "corrupt", "events.jsonl: a line is no event"),
    ]
    n = F.coalesce("n_lines", F.lit(0))
    bound = [
        (F.col("marker.sha256").isNull(), "unavailable", "finalized.json: over its size limit"),
        (m["schema_version"].isNull() | m["run_id"].isNull(), "corrupt", "finalized.json: not a marker"),
        (~m["schema_version"].isin(1, 2), "unsupported", "unsupported finalization marker schema"),
        ((m["schema_version"] == 2) != m["raw_manifest"].isNotNull(), "corrupt", "finalized.json: version and raw manifest contradict"),
        (m["run_id"] != F.col("run_id"), "corrupt", "finalization marker run ID does not match record"),
        *_check("metadata", "metadata.json", m["metadata"]),
        *_check("events", "events.jsonl", m["events"]),
        *((m["raw_manifest"].isNotNull() & when, status, said) for when, status, said in _check("manifest", "raw-integrity.json", m["raw_manifest"])),
        *decoded,
        ((version == 4) != (m["schema_version"] == 2), "corrupt", "metadata and finalization marker versions contradict"),
        *lines_,
        ((n != m["event_count"]) | (n != F.col("record.parsed_events")), "corrupt", "event count mismatch"),
    ]
    current = (version >= 3) | (F.col("record.state") == "running")
    free = [
        (F.col("metadata").isNull(), "corrupt", "metadata.json: missing"),
        (F.col("metadata.sha256").isNull(), "unavailable", "metadata.json: over its size limit"),
        *decoded,
        (current, "unfinalized", "no final marker; capture may still be running or may have stopped before storage finalization"),
        (F.col("events").isNull(), "corrupt", "events.jsonl: missing"),
        (F.col("events.sha256").isNull(), "unavailable", "events.jsonl: over its size limit"),
        *lines_,
    ]
    pick = lambda rules, k: first_failure([(x[0], F.lit(x[k])) for x in rules])
    storage = F.when(has, F.coalesce(pick(bound, 1), F.lit("verified"))).otherwise(F.coalesce(pick(free, 1), F.lit("unverified")))
    detail = F.when(has, F.coalesce(pick(bound, 2), F.lit("saved files match the final marker"))).otherwise(F.coalesce(pick(free, 2), F.lit("storage integrity unverified: legacy record has no finalization checksums")))
    rows = rows.withColumn("storage", storage).withColumn("detail", detail)
    receipt, log = r["receipt"], F.col("raw")
    n_log = F.regexp_count(F.col("raw.content").cast("string"), F.lit("\n")) + F.when((F.col("raw.bytes") > 0) & ~F.col("raw.content").cast("string").endswith("\n"), 1).otherwise(0)
    promised = [
        (receipt["status"] == "unverified", "unverified", "no receipt of the raw log"),
        (log.isNull(), "corrupt", "raw/trace.log: missing"),
        (F.col("raw.bytes") != receipt["bytes"], "corrupt", "raw/trace.log: byte count or SHA-256 mismatch"),
        (F.col("raw.sha256").isNull(), "unavailable", "raw/trace.log: over its size limit"),
        (n_log != receipt["logical_lines"], "corrupt", "raw/trace.log: logical line count differs from normalization receipt"),
        (F.col("raw.sha256") != receipt["sha256"], "corrupt", "raw/trace.log: byte count or SHA-256 mismatch"),
    ]
    judged = (F.col("storage") == "verified") & m["raw_manifest"].isNotNull()
    waiting = (F.col("storage") == "unfinalized") & (version == 4)
    raw = F.when(judged, F.coalesce(pick(promised, 1), F.lit("verified"))).when(waiting, "unverified")
    said = F.when(judged, F.coalesce(F.when(receipt["status"] == "unverified", receipt["reason"]), pick(promised, 2), F.lit("saved raw bytes match their receipt"))).when(waiting, "no bound final marker; raw normalization-stream receipt is unverified")
    return rows.select("run_id", "record", "storage", "detail", raw.alias("raw_status"), said.alias("raw_detail"), "m", F.col("r").alias("manifest"))


def contracted(spark: SparkSession, root: str) -> DataFrame:
    """The load decision of all records with their contracts: run_id, record, storage, detail, raw_status, raw_detail.

    Only what loads by its bytes is judged: metadata with the facts of its events, then for
    version 4 the replay of generations and provenance, then the receipt. A record that breaks
    one is corrupt, or unsupported, with the first contract it breaks; its raw status is gone.
    """
    rows = loaded(files(spark, root)).drop("m")
    saved = events(spark, root).where("event is not null").select("run_id", "event_index", "event.*").select("*", "evidence.*")
    judged = rows.where(F.col("storage").isin("verified", "unverified")).select("run_id", "storage", "manifest", "record.*").join(records.run_facts(saved), "run_id", "left")
    replay = judged.where("schema_version = 4").select("run_id", "completeness", "warnings", "target_exit_raw", "target_provenance")
    replay = provenance_errors(replay, saved.withColumn("pair_id", F.lit(0))).select("run_id", F.col("error").alias("replay_error"))
    said = lambda contract, error: F.when(error.isNotNull(), F.concat(F.lit(f"{contract}: "), error))
    of_run = F.coalesce(records.run_error(F.col("storage") == "verified"), F.col("replay_error"))
    error = F.coalesce(of_run, first_failure(records.receipt_rules()))
    kind = F.lower(records.failure_kind(error, F.lit(None).cast("string")))
    broken = judged.join(replay, "run_id", "left").select("run_id", F.coalesce(said("run contract", of_run), said("raw manifest contract", error)).alias("broken"), kind.alias("kind"))
    rows = rows.join(broken, "run_id", "left")
    whole = F.col("broken").isNull()
    return rows.select("run_id", "record", F.coalesce("kind", "storage").alias("storage"), F.coalesce("broken", "detail").alias("detail"), *(F.when(whole, F.col(x)).alias(x) for x in ("raw_status", "raw_detail")))


def list_json(rows: DataFrame) -> DataFrame:
    """One JSON object per row of :func:`loaded`: metadata with keys in byte order, or the hints of a damaged record."""
    readable = F.col("storage").isin("verified", "unverified", "unfinalized")
    keep_null = {"ignoreNullFields": "false"}
    names = sorted([f.name for f in METADATA.fields if f.name not in ("evidence_contract", "target_provenance")] + ["directory", "storage_integrity"])
    integrity = F.struct(F.col("detail"), F.col("storage").alias("status"))
    cell = lambda n: F.col("run_id").alias(n) if n == "directory" else integrity.alias(n) if n == "storage_integrity" else F.col(f"record.{n}").alias(n)
    whole = F.to_json(F.struct(*map(cell, names)), keep_null)
    later = F.to_json(F.struct(F.col("record.evidence_contract").alias("evidence_contract"), F.when(F.col("raw_status").isNotNull(), F.struct(F.col("raw_detail").alias("detail"), F.col("raw_status").alias("status"))).alias("raw_integrity"), F.col("record.target_provenance").alias("target_provenance")))
    whole = F.when(later == "{}", whole).otherwise(F.concat(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit(","), F.substr(later, F.lit(2))))
    hints = F.to_json(F.struct(F.col("run_id").alias("directory"), F.col("run_id").alias("id"), F.col("record.name").alias("name"), integrity.alias("storage_integrity")), keep_null)
    return rows.select("run_id", F.when(readable, whole).otherwise(hints).alias("json")).orderBy("run_id")


def show_json(spark: SparkSession, root: str, key: str) -> str:
    """The record as stored: metadata, events in order, integrity."""
    run_id = resolve(root, key)
    row = loaded(files(spark, root).where(F.col("run_id") == run_id)).first().asDict(recursive=True)
    record = {k: v for k, v in row["record"].items() if v is not None or k not in ("evidence_contract", "target_provenance")}
    found = events(spark, root).where((F.col("run_id") == run_id) & F.col("event").isNotNull()).orderBy("event_index").select("event").toLocalIterator()
    out = {"metadata": record, "events": [{k: v for k, v in e.event.asDict(recursive=True).items() if v is not None or not k.endswith("_generation")} for e in found]}
    out["storage_integrity"] = {"status": row["storage"], "detail": row["detail"]}
    if row["raw_status"]:
        out["raw_integrity"] = {"status": row["raw_status"], "detail": row["raw_detail"]}
    return json.dumps(out, indent=2, ensure_ascii=False)


def record_ids(root: str) -> list[str]:
    """Names of the record folders of a local store, in byte order."""
    folder = os.path.join(root, "runs")
    return sorted(os.listdir(folder), key=os.fsencode) if os.path.isdir(folder) else []


def resolve(root: str, key: str) -> str:
    """The one record whose id or name is ``key``; several or none are an error with their number."""
    found = []
    for run_id in record_ids(root):
        try:
            with open(os.path.join(root, "runs", run_id, "metadata.json"), "rb") as src:
                name = json.load(src).get("name")
        except (OSError, ValueError, AttributeError):
            name = None
        if key in (run_id, name):
            found.append(run_id)
    if len(found) != 1:
        raise LookupError(f"{len(found)} records match {key!r}")
    return found[0]
