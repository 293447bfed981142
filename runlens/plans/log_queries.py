"""Queries from raw bytes on: parsing of logs, load decisions, effects of flags, text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import decode, text
from runlens.operators import capture, parse
from runlens.sources import trace
from runlens.sources.adapter import trace_events

from .queries import query


def spelled(content: Column) -> Column:
    """A quoted argument with every byte as \\xNN."""
    return F.concat(F.lit('"'), F.regexp_replace(F.lower(F.hex(F.encode(content, "UTF-8"))), "(..)", r"\\x$1"), F.lit('"'))


def raw_lines(spark, sf_dir: str) -> DataFrame:
    """The adapted events as lines of a raw log: run_id, line, text.

    Event i begins at line 10 i + 10; a quarter of the file events are interrupted and resume
    45 lines later, among lines of other tasks. Operands are absolute, relative, noted at
    their directory in full or in part, or bytes outside UTF-8; some calls can't be parsed.
    """
    e, k = trace_events(spark, sf_dir), F.col("k")
    kind, op, success = F.col("kind"), F.col("operation"), F.col("outcome") == "success"
    v = F.when(op == "openat", k % 7).otherwise(0)
    bad, split = (kind == "file") & (k % 50 >= 48), (kind == "file") & (k % 4 == 0) & (k % 50 < 48)
    relative = spelled(F.concat(F.lit("rel/"), k.cast("string")))
    directory = F.when(v == 2, r"3<\x2f\x64>").when(v == 3, "3</gone (deleted)>").when(v == 5, "7").otherwise("AT_FDCWD")
    operand = F.when(v.isin(1, 2, 3, 5), relative).when(v == 4, F.concat(F.lit(r'"\x2fb\xff'), k.cast("string"), F.lit('"'))).otherwise(spelled(F.col("path")))
    head = F.when(op == "openat", F.concat(F.lit("openat("), directory, F.lit(", "), operand, F.lit(", O_RDONLY"))).otherwise(F.concat(F.lit("access("), operand, F.lit(", R_OK")))
    value = F.when(success, F.when(v == 5, r"3<\x2f\x72>").otherwise("3")).otherwise(F.concat(F.lit("-1 "), F.col("outcome"), F.lit(" (failed)")))
    tail = F.concat(F.lit(") = "), value)
    program = F.concat(F.lit("execve("), spelled(F.col("path")), F.lit(r', ["\x61", "k'), k.cast("string"), F.lit('"], 0x0 /* 9 vars */) = '), F.when(success, "0").otherwise(F.concat(F.lit("-1 "), F.col("outcome"), F.lit(" (failed)"))))
    spawn = F.when(k % 3 == 0, "fork()").when(k % 3 == 1, "clone(child_stack=NULL, flags=CLONE_FS|CLONE_VM|SIGCHLD)").otherwise("clone3({flags=CLONE_VM, exit_signal=SIGCHLD, stack=0x7f}, 88)")
    whole = (
        F.when(kind == "exit", F.concat(F.lit("+++ "), F.col("outcome"), F.lit(" +++")))
        .when(kind == "exec", program)
        .when(kind == "spawn", F.concat(spawn, F.lit(" = "), F.col("child_pid")))
        .when(bad, F.when(k % 50 == 48, "read(3) = 0").otherwise(r'openat(AT_FDCWD, "\x2f"..., O_RDONLY) = 3'))
        .when(split, F.concat(head, F.lit(" <unfinished ...>")))
        .otherwise(F.concat(head, tail))
    )
    at = 10 * F.col("event_index") + 10
    second = F.when(split, F.struct((at + 45).alias("line"), F.concat(F.lit("<... "), op, F.lit(" resumed>"), tail).alias("body")))
    both = F.filter(F.array(F.struct(at.alias("line"), whole.alias("body")), second), lambda x: x.isNotNull())
    rows = e.select("run_id", "pid", F.explode(both).alias("x"))
    return rows.select("run_id", F.col("x.line").alias("line"), F.concat("pid", F.lit(" "), "x.body").alias("text"))


#: The same log in SQL: attributes of each event (ev), control rows of tasks (ct) and the state of halves (hs).
LOG = r"""ev AS (SELECT *, 10*event_index+10 AS pos, kind='file' AND k%50>=48 AS bad, kind='file' AND k%4=0 AND k%50<48 AS split, CASE WHEN operation='openat' THEN k%7 ELSE 0 END AS v, CASE WHEN kind='spawn' THEN ['fork','clone','clone3'][k%3+1] ELSE operation END AS op FROM t),
ep AS (SELECT *, CASE WHEN v=1 THEN 'relative:rel/' || k || ' [cwd unresolved]' WHEN v=2 THEN '/d/rel/' || k WHEN v=3 THEN 'relative:rel/' || k || ' [dirfd:/gone (deleted)]' WHEN v=4 THEN '/b\xff' || k WHEN v=5 THEN 'relative:rel/' || k || ' [dirfd unresolved]' WHEN kind='spawn' THEN child_pid ELSE path END AS said FROM ev),
c0 AS (SELECT run_id, pid, pos AS line, 'U' AS h, op, event_index AS id FROM ep WHERE split UNION ALL SELECT run_id, pid, pos+45, 'R', op, event_index FROM ep WHERE split UNION ALL SELECT run_id, pid, pos, 'X', op, event_index FROM ep WHERE kind='exit' UNION ALL SELECT run_id, child_pid, pos, 'K', op, event_index FROM ep WHERE kind='spawn' AND outcome='success'),
c1 AS (SELECT *, last_value(CASE WHEN h<>'K' THEN h END IGNORE NULLS) OVER (PARTITION BY run_id, pid ORDER BY line, CASE WHEN h='K' THEN 1 ELSE 0 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM c0),
ct AS (SELECT run_id, pid, line, h, op, id FROM c1 WHERE h<>'K' OR before_='U'),
hs AS (SELECT *, lag(h) OVER w AS lh, lag(op) OVER w AS lo, lag(line) OVER w AS ll, lag(id) OVER w AS lid, lead(h) OVER w AS nh, lead(line) OVER w AS nl FROM ct WINDOW w AS (PARTITION BY run_id, pid ORDER BY line, CASE WHEN h='K' THEN 1 ELSE 0 END)),
es AS (SELECT run_id, pos AS line, pos AS end_line, pid, kind, op AS operation, CASE WHEN v=5 AND outcome='success' THEN '/r' ELSE said END AS path, CASE WHEN kind='exit' THEN '+++ ' || outcome || ' +++' ELSE outcome END AS outcome, CASE WHEN kind='exec' THEN 'a,k' || k END AS argv, child_pid, CASE WHEN kind='spawn' THEN ['PrivateFs','SharedFs','PrivateFs'][k%3+1] END AS effect FROM ep WHERE NOT split AND NOT bad
 UNION ALL SELECT hs.run_id, hs.ll, hs.line, hs.pid, 'file', hs.op, CASE WHEN u.v IN (1,2,3,5) AND r.v=5 AND r.outcome='success' THEN '/r' ELSE u.said END, r.outcome, NULL, NULL, NULL FROM hs JOIN ep u ON u.event_index=hs.lid JOIN ep r ON r.event_index=hs.id WHERE hs.h='R' AND hs.lh='U' AND hs.lo=hs.op)"""


@query(LOG + " SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY end_line)-1 AS event_index, line, end_line, pid, kind, operation, path, outcome, argv, child_pid, effect FROM es")
def parsed_events(spark, sf_dir):
    """Raw lines to events: framing, stitching, arguments, paths, argv, effects."""
    events = parse.observations(raw_lines(spark, sf_dir)).events
    return events.select("run_id", "event_index", "line", "end_line", "pid", "kind", "operation", "path", "outcome", F.array_join("argv", ",").alias("argv"), "child_pid", "effect")


WARNED = r""", wn AS (SELECT run_id, nl AS place, ': replaced unfinished call' AS said FROM hs WHERE h='U' AND nh='U'
 UNION ALL SELECT run_id, line, ': unmatched resumed call' FROM hs WHERE h='R' AND coalesce(lh,'')<>'U'
 UNION ALL SELECT run_id, line, ': resumed syscall does not match line ' || ll FROM hs WHERE h='R' AND lh='U' AND lo<>op
 UNION ALL SELECT run_id, nl, ': unfinished call from line ' || line || ' ended with task ' || pid || ' exit; consult raw evidence' FROM hs WHERE h='U' AND nh='X'
 UNION ALL SELECT run_id, nl, ': task ' || pid || ' unfinished call from line ' || line || ' predates spawn entry at line ' || nl || '; consult raw evidence' FROM hs WHERE h='U' AND nh='K'
 UNION ALL SELECT run_id, line, ': unfinished call at end of trace' FROM hs WHERE h='U' AND nh IS NULL
 UNION ALL SELECT run_id, pos, ': abbreviated trace data; inspect raw evidence' FROM ep WHERE bad AND k%50=49
 UNION ALL SELECT run_id, pos, ': unsupported or incomplete event: ' || CASE WHEN k%50=48 THEN 'read(3) = 0' ELSE 'openat(AT_FDCWD, "\x2f"..., O_RDONLY) = 3' END FROM ep WHERE bad)"""


@query(LOG + WARNED + " SELECT run_id, 'raw/trace.log:' || place || said AS text FROM wn")
def parse_warnings(spark, sf_dir):
    return parse.observations(raw_lines(spark, sf_dir)).warnings.select("run_id", "text")


@query(LOG + WARNED + ", el AS (SELECT run_id, line AS pos, count(*) AS n, min(end_line) AS end_line FROM es GROUP BY ALL) SELECT wn.run_id, wn.place AS line, el.end_line FROM wn JOIN el ON el.run_id=wn.run_id AND el.pos=wn.place WHERE el.n=1")
def warned_events(spark, sf_dir):
    """Warnings of lines where exactly one event begins."""
    events, warnings = parse.observations(raw_lines(spark, sf_dir))
    return parse.warned_events(events, warnings).select("run_id", "line", "end_line")


@query(LOG + " SELECT ep.run_id, count(*) FILTER (WHERE NOT split AND kind<>'exit') + (SELECT count(*) FROM hs WHERE hs.run_id=ep.run_id AND h='R' AND lh='U' AND lo=op) AS n_calls, (SELECT count(*) FROM es WHERE es.run_id=ep.run_id AND es.kind<>'exit') AS n_events, count(*) FILTER (WHERE bad) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM ep GROUP BY ep.run_id")
def normalization_audit(spark, sf_dir):
    """Whole raw calls against events, both ways."""
    rows = raw_lines(spark, sf_dir)
    return parse.coverage(rows, parse.observations(rows).events)


# Printed flags of clone, clone3 and unshare with their effects.
EFFECTS = [
    ("clone", "CLONE_THREAD|CLONE_SIGHAND|CLONE_VM", "", "PrivateFs"),
    ("clone", "CLONE_THREAD|SIGCHLD", "", "Unknown"),
    ("clone", "CLONE_SIGHAND|SIGCHLD", "", "Unknown"),
    ("clone", "CLONE_FS|CLONE_VM|SIGCHLD", "", "SharedFs"),
    ("clone", "SIGCHLD|SIGUSR1", "", "Unknown"),
    ("clone", "CLONE_NEWNS|SIGRTMIN+3", "", "PrivateFsNamespaceUncertain"),
    ("clone", "CLONE_NEWTIME|SIGCHLD", "", "Unknown"),
    ("clone", "0x1200011", "", "PrivateFs"),
    ("clone", "CLONE_PIDFD|CLONE_DETACHED", "", "Unknown"),
    ("clone3", "CLONE_NEWTIME", "SIGCHLD", "PrivateFsNamespaceUncertain"),
    ("clone3", "CLONE_VM|CLONE_THREAD|CLONE_SIGHAND|CLONE_FS", "0", "SharedFs"),
    ("clone3", "CLONE_VM|CLONE_THREAD|CLONE_SIGHAND", "SIGCHLD", "Unknown"),
    ("clone3", "CLONE_AUTOREAP|CLONE_PIDFD|CLONE_PIDFD_AUTOKILL", "0", "PrivateFs"),
    ("clone3", "CLONE_PIDFD_AUTOKILL", "0", "Unknown"),
    ("clone3", "CLONE_DETACHED", "0", "Unknown"),
    ("clone3", "0", "65", "Unknown"),
    ("unshare", "CLONE_FS", "", "SplitFs"),
    ("unshare", "CLONE_NEWNS", "", "SplitFsNamespaceUncertain"),
    ("unshare", "CLONE_NEWUTS", "", "ConnectedFsNamespaceUncertain"),
    ("unshare", "UNSHARE_EMPTY_MNTNS", "", "SplitFsNamespaceUncertain"),
    ("unshare", "CLONE_FILES | CLONE_SYSVSEM", "", "NoFsChange"),
    ("unshare", "CLONE_PARENT", "", "Unknown"),
    ("unshare", "", "", "Unknown"),
]
_WANTED = ", ".join(f"'{x[3]}'" for x in EFFECTS)


@query(f"WITH w AS (SELECT event_id, CAST(event_id % {len(EFFECTS)} AS INT) AS i FROM events) SELECT event_id, [{_WANTED}][i+1] AS effect FROM w", adapted=False)
def call_effects(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*(F.lit(x[n]) for x in EFFECTS)), (F.col("event_id") % len(EFFECTS) + 1).cast("int"))
    call, flags, signal = pick(0), pick(1), pick(2)
    argument = F.concat(F.lit("{flags="), flags, F.lit(", exit_signal="), signal, F.lit(", stack=0}"))
    args = F.array(F.lit("child_stack=NULL"), F.when(call == "clone3", argument).otherwise(F.concat(F.lit("flags="), flags)))
    effect = F.when(call == "clone", decode.clone_effect(decode.field(args, "flags="))).when(call == "clone3", decode.clone3_effect(decode.field(args, "flags="), decode.field(args, "exit_signal="))).otherwise(decode.unshare_effect(flags))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", effect.alias("effect"))


@query(r"""SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)"(?:[^"\\]|\\.)*(?:"|\\?$)|[\[{]|[^\[\]{},:" \n\r\t]+')) AS BIGINT) AS n FROM pages WHERE html IS NOT NULL""", adapted=False)
def json_tokens(spark, sf_dir):
    """The token counter of the JSON budget, on whole pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").where("html is not null").select("page_id", trace.json_values(F.col("html")).cast("long").alias("n"))


@query(r"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'O_CREAT,O_WRONLY' WHEN 1 THEN '' ELSE 'O_RDONLY' END AS flags, CASE event_id % 3 WHEN 0 THEN 'open(HOME/é/' || event_id || ')' WHEN 1 THEN '\xff/x' ELSE 'HOME' END AS shown FROM events", adapted=False)
def redaction(spark, sf_dir):
    """Flags named in raw calls; escapes spelled out and private prefixes replaced."""
    i = F.col("event_id")
    call = F.when(i % 3 == 0, "openat(3, x, O_WRONLY|O_CREAT|O_WRONLY, 0666)").when(i % 3 == 1, "access(xO_NO, R_OK)").otherwise("open(O_RDONLY)")
    raw = F.when(i % 3 == 0, F.concat(F.lit(r"open(\x2f\x68\x6f\x6d\x65/me/\xc3\xa9/"), i.cast("string"), F.lit(")"))).when(i % 3 == 1, r"\xff/x").otherwise("/home/me")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(text.raw_flags(call), ",").alias("flags"), text.redacted(raw, [("/home/me", "HOME")]).alias("shown"))


STATES = """CASE o_orderkey % 12 WHEN 0 THEN 'verified' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'corrupt' WHEN 3 THEN 'corrupt' WHEN 4 THEN 'unfinalized' WHEN 5 THEN 'unverified' WHEN 6 THEN 'corrupt' WHEN 7 THEN 'verified' WHEN 8 THEN 'verified' WHEN 9 THEN 'unsupported' WHEN 10 THEN 'unsupported' ELSE 'corrupt' END"""
DETAILS = """CASE o_orderkey % 12 WHEN 1 THEN 'metadata.json: byte count or SHA-256 mismatch' WHEN 2 THEN 'finalization marker run ID does not match record' WHEN 3 THEN 'event count mismatch' WHEN 4 THEN 'no final marker; capture may still be running or may have stopped before storage finalization'
 WHEN 5 THEN 'storage integrity unverified: legacy record has no finalization checksums' WHEN 6 THEN 'metadata.json: missing' WHEN 9 THEN 'unsupported finalization marker schema' WHEN 10 THEN 'unsupported metadata schema' WHEN 11 THEN 'events.jsonl: incomplete final line' ELSE 'saved files match the final marker' END"""


def stored_files(spark, sf_dir: str) -> DataFrame:
    """Files of a record per order, whole or broken in one of eleven ways."""
    k, run_id = F.col("o_orderkey") % 12, F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("-1"))
    version = F.when(k.isin(7, 8), 4).when(k == 5, 2).when(k == 10, 7).otherwise(3)
    event = F.to_json(F.struct(F.when(k.isin(7, 8), 3).otherwise(2).alias("schema_version"), F.lit("7").alias("pid"), F.lit("file").alias("kind"), F.lit("open").alias("operation"), F.lit("/x").alias("path"), F.lit("success").alias("outcome")))
    lines = F.concat(event, F.when(k == 11, F.lit("")).otherwise(F.lit("\n")))
    metadata = F.to_json(F.struct(version.alias("schema_version"), run_id.alias("id"), F.lit("n").alias("name"), F.lit("completed").alias("state"), F.lit(1).alias("parsed_events"), F.lit(2).alias("raw_lines")))
    log = F.lit("7 open(x) = 3\n7 +++ exited with 0 +++\n")

    def file(content: Column) -> Column:
        return F.struct(content.cast("binary").alias("content"), F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"), F.lit(True).alias("is_utf8"), F.lit(None).cast("string").alias("error"))

    check = lambda content: F.struct(F.octet_length(content).cast("long").alias("bytes"), F.sha2(content, 256).alias("sha256"))
    receipt = F.struct(F.lit("parsed").alias("status"), F.octet_length(log).cast("long").alias("bytes"), F.lit(2).cast("long").alias("logical_lines"), F.sha2(log, 256).alias("sha256"))
    manifest = F.when(version == 4, F.to_json(F.struct(F.lit(1).alias("schema_version"), run_id.alias("run_id"), F.lit("raw/trace.log").alias("file"), receipt.alias("receipt"))))
    marker = F.to_json(F.struct(F.when(k == 9, 9).when(version == 4, 2).otherwise(1).alias("schema_version"), F.when(k == 2, "other").otherwise(run_id).alias("run_id"), F.when(k == 3, 2).otherwise(1).alias("event_count"), check(lines).alias("events"), check(metadata).alias("metadata"), F.when(version == 4, check(manifest)).alias("raw_manifest")))
    saved = F.when(k == 1, F.concat(metadata, F.lit(" "))).otherwise(metadata)
    given = {
        "marker": F.when(~k.isin(4, 5, 6, 10), file(marker)), "metadata": F.when(k != 6, file(saved)), "events": file(lines), "manifest": F.when(manifest.isNotNull(), file(manifest)),
        "raw": file(F.when(k == 8, F.replace(log, F.lit("open"), F.lit("OPEN"))).otherwise(log)), "n_lines": F.lit(1).cast("long"), "first_bad": F.lit(None).cast("long"), "ended": k != 11,
    }
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(run_id.alias("run_id"), *(c.alias(n) for n, c in given.items()))


@query(f"SELECT 'a' || o_orderkey || '-1' AS run_id, {STATES} AS storage, {DETAILS} AS detail, CASE o_orderkey % 12 WHEN 7 THEN 'verified' WHEN 8 THEN 'corrupt' END AS raw_status FROM orders", adapted=False)
def load_decision(spark, sf_dir):
    return trace.loaded(stored_files(spark, sf_dir)).select("run_id", "storage", "detail", "raw_status")


@query(f"""SELECT 'a' || o_orderkey || '-1' AS run_id, CASE WHEN {STATES} IN ('corrupt','unsupported') THEN CASE WHEN o_orderkey % 12 = 6 THEN NULL ELSE 'n' END ELSE 'n' END AS name, {STATES} AS status, CASE WHEN {STATES} NOT IN ('corrupt','unsupported') THEN 'completed' END AS state, CASE o_orderkey % 12 WHEN 7 THEN 'verified' WHEN 8 THEN 'corrupt' END AS raw FROM orders""", adapted=False)
def list_rows(spark, sf_dir):
    """The JSON list, read back."""
    rows = trace.list_json(trace.loaded(stored_files(spark, sf_dir)))
    at = lambda path: F.get_json_object("json", path)
    return rows.select("run_id", at("$.name").alias("name"), at("$.storage_integrity.status").alias("status"), at("$.state").alias("state"), at("$.raw_integrity.status").alias("raw"))


DECISIONS = """WITH f AS (SELECT o_orderkey AS o, CASE WHEN o % 5=0 THEN NULL WHEN o % 7=1 THEN '+++ killed by SIGODD +++' WHEN o % 7=2 THEN '+++ killed by SIGTERM +++' ELSE '+++ exited with ' || (o % 3) || ' +++' END AS raw,
 CASE WHEN o % 5<>0 AND o % 7 NOT IN (1,2) THEN o % 3 END AS tc, CASE WHEN o % 5<>0 AND o % 7=2 THEN 15 END AS ts, CASE WHEN o % 11=0 THEN 'start refused' WHEN o % 11=1 THEN 'wait failed' END AS reason,
 CASE WHEN o % 11 > 1 AND o % 13<>0 THEN CASE WHEN o % 13=1 THEN 3 WHEN o % 7<>2 THEN o % 3 END END AS cc, CASE WHEN o % 11 > 1 AND o % 13 > 1 AND o % 7=2 THEN 15 END AS cs,
 CASE WHEN o % 17=0 THEN 2 END AS rs, CASE WHEN o % 19=0 THEN 'supervision lost' END AS lost FROM orders),
d AS (SELECT l_orderkey AS o, l_partkey AS ms, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_linenumber % 4=3),
b AS (SELECT l_orderkey AS o, l_suppkey * 20 AS seen, l_partkey AS lim, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_partkey DESC) AS n FROM lineitem WHERE l_linenumber % 4<>3 AND l_suppkey * 20 > l_partkey),
x AS (SELECT f.*, d.ms, b.seen, b.lim, (cc IS NULL AND cs IS NULL) OR (coalesce(tc,ts) IS NOT NULL AND (cc IS DISTINCT FROM tc OR cs IS DISTINCT FROM ts)) AS un FROM f LEFT JOIN d ON d.o=f.o AND d.n=1 LEFT JOIN b ON b.o=f.o AND b.n=1),
y AS (SELECT *, CASE WHEN rs IS NOT NULL THEN 'interrupted' WHEN raw IS NULL OR reason IS NOT NULL OR un OR ms IS NOT NULL OR lim IS NOT NULL OR lost IS NOT NULL THEN 'capture_failed' ELSE 'completed' END AS state,
 concat_ws('|', CASE WHEN o % 3=0 THEN 'p' END, CASE WHEN o % 23=0 THEN 'cannot read trace: gone' END, CASE WHEN o % 5<>0 AND o % 7=1 THEN 'unrecognized target termination signal' END, CASE WHEN o % 4=0 THEN 'process completion not observed for PIDs: 7, 9:2' END,
  CASE WHEN raw IS NULL THEN 'root process completion not observed; capture incomplete' END, CASE WHEN reason IS NOT NULL THEN reason WHEN un THEN 'collector status does not confirm target completion' END,
  'capture duration limit exceeded (limit: ' || ms || ' ms)', 'capture trace byte limit exceeded (observed: ' || seen || ' bytes, limit: ' || lim || ' bytes)', lost) AS warnings FROM x)
SELECT o AS run_id, state, warnings, CASE WHEN state<>'completed' THEN 'incomplete' WHEN warnings='' THEN 'complete_for_supported_events' ELSE 'partial' END AS completeness, raw AS target_exit_raw, CAST(tc AS BIGINT) AS exit_code, CAST(ts AS BIGINT) AS signal, CAST(cc AS BIGINT) AS collector_exit_code, CAST(cs AS BIGINT) AS collector_signal,
 CAST(CASE state WHEN 'interrupted' THEN 128+rs WHEN 'capture_failed' THEN 125 ELSE coalesce(tc,128+ts,cc,128+cs,125) END AS INT) AS cli_exit, CASE WHEN o % 29=0 THEN 'suppressed_length_unverified' WHEN lim IS NOT NULL THEN 'suppressed_byte_limit' ELSE 'parse' END AS admission FROM y"""


@query(DECISIONS, adapted=False)
def capture_decision(spark, sf_dir):
    """Facts of a capture per order, its limits observed by the order's lines."""
    o, n = F.col("o_orderkey"), F.col("l_linenumber")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    seen = lines.select(F.col("l_orderkey").alias("run_id"), n.alias("seq"), F.when(n % 4 == 3, "duration").otherwise("bytes").alias("kind"), (F.col("l_suppkey") * 20).alias("observed"), F.col("l_partkey").alias("limit"))
    known, reaped = o % 5 != 0, o % 11 > 1
    odd, term = o % 7 == 1, o % 7 == 2
    words = lambda *w: F.array(*map(F.lit, w))
    given = {
        "target_raw": F.when(known, F.when(odd, "+++ killed by SIGODD +++").when(term, "+++ killed by SIGTERM +++").otherwise(F.concat(F.lit("+++ exited with "), (o % 3).cast("string"), F.lit(" +++")))),
        "target_code": F.when(known & ~odd & ~term, o % 3), "target_signal": F.when(known & term, 15).cast("long"),
        "collector": F.when(o % 11 == 0, "not_started").when(o % 11 == 1, "failed").otherwise("reaped"), "collector_reason": F.when(o % 11 == 0, "start refused").when(o % 11 == 1, "wait failed"),
        "collector_code": F.when(o % 13 == 1, 3).when((o % 13 > 1) & ~term, o % 3).cast("long"), "collector_signal": F.when((o % 13 > 1) & term, 15).cast("long"),
        "recorder_signal": F.when(o % 17 == 0, 2), "supervision_error": F.when(o % 19 == 0, "supervision lost"), "read_error": F.when(o % 23 == 0, "gone"),
        "missing": F.when(o % 4 == 0, words("7", "9:2")), "warnings": F.when(o % 3 == 0, words("p")),
    }
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(o.alias("run_id"), *(v.alias(k) for k, v in given.items()))
    facts = runs.join(capture.limit_facts(seen), "run_id", "left")
    admitted = facts.select("run_id", capture.admission(F.col("run_id") % 29 == 0).alias("admission"))
    return capture.decide(facts).withColumn("warnings", F.array_join("warnings", "|")).join(admitted, "run_id")
