"""Queries of the audits and of the replay of saved generations, over adapted events with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.vocab import IDENTITY_CONTRACT, REPLAY_ERRORS, SELECTION_RULE, UNTRUSTED
from runlens.operators import audits, compare, lifecycle, parse, provenance
from runlens.sources.adapter import trace_events

from .log_queries import LOG, WARNED, raw_lines
from .queries import CHANGES, KEYS, PRESENTED, TIMELINE, query

c = F.col
DOUBTED = ", ".join(f"'{x}'" for x in UNTRUSTED)


def saved_events(events: DataFrame) -> DataFrame:
    """Events with their saved generations; some pairs have a wrong ordinal or a lost doubt."""
    rows = lifecycle.timeline(events).withColumn("born", F.max("origin").over(Window.partitionBy("run_id", "task", "ordinal")))
    acts = rows.where("t <> 'C'").select("run_id", "event_index", c("ordinal").alias("act"), c("born").isin(UNTRUSTED).alias("u1"))
    births = rows.where("t = 'C'").select("run_id", "event_index", c("ordinal").alias("birth"), (c("origin") == "LiveCollision").alias("u2"))
    rows = events.join(acts, ["run_id", "event_index"]).join(births, ["run_id", "event_index"], "left")
    of = lambda rest: c("pair_id") % 4 == rest
    task = c("act") + F.when(of(1) & (c("event_index") % 97 == 0), 1).otherwise(0)
    child = c("birth") + F.when(of(3) & (c("k") % 3 == 0), 1).otherwise(0)
    doubt = (c("u1") | F.coalesce("u2", F.lit(False))) & ~(of(2) & (c("k") % 5 == 0))
    return rows.select(*events.columns, F.lit("raw/trace.log").alias("file"), task.alias("task_generation"), child.alias("child_generation"), doubt.alias("context_uncertain"))


def saved_runs(events: DataFrame) -> DataFrame:
    """Metadata of the runs: every seventh pair claims to be whole; the provenance of others names wrong events."""
    pair, right = c("pair_id"), c("side") == "right"
    runs = events.select("pair_id", "side", "run_id").distinct().join(lifecycle.root_exec(events), "run_id", "left")
    held = F.struct("line", "end_line", "outcome", c("event_index").alias("at"))
    at = events.select("run_id", "event_index", held.alias("held"))
    runs = runs.join(at.select("run_id", c("event_index").alias("root_event"), c("held").alias("exec")), ["run_id", "root_event"], "left")
    runs = runs.join(at.select("run_id", c("event_index").alias("exit_event"), c("held").alias("exit")), ["run_id", "exit_event"], "left")
    ref = lambda index, e, shift: F.struct(index.alias("index"), F.struct(F.lit("raw/trace.log").alias("file"), (e["line"] + shift).alias("line"), (e["end_line"]).alias("end_line")).alias("evidence"))
    no_exec = (pair % 5 == 4) & right
    root_exec = F.when(no_exec, ref(c("exit.at"), c("exit"), 0)).otherwise(ref(c("root_event"), c("exec"), F.when(pair % 5 == 1, 1).otherwise(0)))
    target_exit = ref(c("exit_event") + F.when((pair % 5 == 4) & ~right, 10**12).otherwise(0), c("exit"), 0)
    root = F.struct(c("root_pid").alias("pid"), (c("ordinal") + F.when(pair % 5 == 2, 1).otherwise(0)).alias("generation"))
    whole = F.struct(F.lit(1).alias("schema_version"), F.lit(SELECTION_RULE).alias("selection_rule"), F.lit(IDENTITY_CONTRACT).alias("identity_contract"), root.alias("root"), root_exec.alias("root_exec"), target_exit.alias("target_exit"))
    raw = F.when((pair % 5 == 3) & right, "killed by SIGKILL").otherwise(c("exit.outcome"))
    done = F.when(pair % 7 == 0, "complete_for_supported_events").otherwise("partial")
    warnings = F.when(pair % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("limits")))
    return runs.select("run_id", done.alias("completeness"), warnings.alias("warnings"), raw.alias("target_exit_raw"), F.when(c("exit_event").isNotNull() & (pair % 5 != 0), whole).alias("target_provenance"))


ROWS = REPLAY_ERRORS["rows"]
REPLAY = TIMELINE + f""", tb AS (SELECT *, max(origin) OVER (PARTITION BY run_id, task, ordinal) AS born FROM tl),
sv AS (SELECT t.*, x.born IN ({DOUBTED}) AS u1, y.ordinal AS birth, coalesce(y.origin='LiveCollision', false) AS u2 FROM t JOIN tb x ON x.run_id=t.run_id AND x.event_index=t.event_index AND x.kind_<>'C' LEFT JOIN tb y ON y.run_id=t.run_id AND y.event_index=t.event_index AND y.kind_='C'),
sy AS (SELECT run_id, event_index, CASE WHEN pair_id%4=1 AND event_index%97=0 THEN '{ROWS[0]}' WHEN u1 AND pair_id%4=2 AND k%5=0 THEN '{ROWS[1]}' WHEN birth IS NOT NULL AND pair_id%4=3 AND k%3=0 THEN '{ROWS[2]}' WHEN u2 AND pair_id%4=2 AND k%5=0 THEN '{ROWS[3]}' END AS says, line, end_line FROM sv),
sf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line, end_line, event_index) AS n FROM sy WHERE says IS NOT NULL) WHERE n=1),
lv AS (SELECT run_id, task, ordinal, max(event_index) FILTER (WHERE kind_='X') AS exit_event, max(born) AS born FROM tb GROUP BY ALL),
lr AS (SELECT run_id, count(*) FILTER (WHERE exit_event IS NULL) AS n_open, bool_or(born IN ({DOUBTED})) AS doubtful FROM lv GROUP BY ALL),
r0 AS (SELECT run_id, event_index, row_number() OVER (PARTITION BY run_id ORDER BY line, end_line, event_index) AS n FROM t WHERE kind='exec' AND outcome='success'),
r1 AS (SELECT r0.run_id, lv.exit_event FROM r0 JOIN tb ON tb.run_id=r0.run_id AND tb.event_index=r0.event_index AND tb.kind_<>'C' JOIN lv ON lv.run_id=tb.run_id AND lv.task=tb.task AND lv.ordinal=tb.ordinal WHERE n=1)
SELECT p.run_id, CASE WHEN says IS NOT NULL THEN says WHEN n_open>0 AND pair_id%7=0 THEN '{REPLAY_ERRORS['open']}' WHEN doubtful AND pair_id%7=0 THEN '{REPLAY_ERRORS['doubtful']}' WHEN r1.exit_event IS NULL THEN NULL WHEN pair_id%5=0 THEN '{REPLAY_ERRORS['absent']}'
 WHEN pair_id%5=1 THEN '{REPLAY_ERRORS['coordinates']}' WHEN pair_id%5=2 THEN '{REPLAY_ERRORS['lifetime']}' WHEN pair_id%5=3 AND side='right' THEN '{REPLAY_ERRORS['exit']}' WHEN pair_id%5=4 AND side='left' THEN '{REPLAY_ERRORS['bounds']}' WHEN pair_id%5=4 THEN '{REPLAY_ERRORS['root']}' END AS error, sf.event_index
 FROM (SELECT DISTINCT pair_id, side, run_id FROM t) p JOIN lr ON lr.run_id=p.run_id LEFT JOIN sf ON sf.run_id=p.run_id LEFT JOIN r1 ON r1.run_id=p.run_id"""


@query(REPLAY)
def provenance_replay(spark, sf_dir):
    """Saved generations and target provenance against the rows, with planted contradictions."""
    events = trace_events(spark, sf_dir)
    return provenance.provenance_errors(saved_runs(events), saved_events(events))


@query(PRESENTED + f""", ro AS (SELECT run_id, arg_min(pid, (line, end_line, event_index)) AS root_pid FROM t WHERE kind='exec' AND outcome='success' GROUP BY ALL),
cw AS (SELECT m.*, coalesce(ch.change, 'FileAccessOutcome') AS change, CASE WHEN m.pair_id%3=0 THEN 'EPERM' ELSE m.right_outcomes END AS wanted FROM m LEFT JOIN ch USING ({KEYS}) WHERE (m.n_left + m.n_right) % 2 = 1),
cg AS (SELECT cw.*, pr.position AS rank FROM cw LEFT JOIN pr ON pr.pair_id=cw.pair_id AND pr.kind=cw.kind AND pr.operation=cw.operation AND pr.path=cw.path AND pr.left_outcomes=cw.left_outcomes AND pr.right_outcomes=cw.wanted),
cn AS (SELECT {KEYS}, count(*) FILTER (WHERE coalesce(pid=root_pid, false)) AS n_root, count(*) AS n FROM c LEFT JOIN ro USING (run_id) GROUP BY {KEYS})
SELECT {KEYS}, 'clue' AS name, n_left > 0 AS required, rank, coalesce(n_left > 0 AND rank <= 5, false) AS in_top, CASE WHEN rank IS NULL THEN 0 ELSE n_root END AS n_root, CASE WHEN rank IS NULL THEN 0 ELSE n - n_root END AS n_descendant FROM cg JOIN cn USING ({KEYS})""")  # fmt: skip
def clue_ranks(spark, sf_dir):
    """Clues for every key with an odd number of events; a third of the pairs expects outcomes that never were."""
    events = trace_events(spark, sf_dir)
    kinds = compare.changes(events).select(*compare.KEY, "change")
    wanted = compare.merged(events).where((c("n_left") + c("n_right")) % 2 == 1).join(kinds, compare.KEY, "left")
    right = F.when(c("pair_id") % 3 == 0, F.array(F.lit("EPERM"))).otherwise(c("right"))
    clues = wanted.select(*compare.KEY, F.lit("clue").alias("name"), (c("n_left") > 0).alias("required"), F.coalesce("change", F.lit("FileAccessOutcome")).alias("change"), "left", right.alias("right"))
    return audits.clue_ranks(events, clues)


@query("x AS (SELECT run_id, path, event_index, row_number() OVER (PARTITION BY run_id, path ORDER BY line, end_line, event_index) AS n FROM t WHERE kind='exec' AND outcome='success') SELECT run_id, path, count(*) AS n, string_agg(event_index, ',' ORDER BY n) FILTER (WHERE n <= 3) AS first FROM x GROUP BY run_id, path")
def exec_successes(spark, sf_dir):
    return audits.exec_successes(trace_events(spark, sf_dir)).withColumn("first", F.array_join("first", ","))


@query(CHANGES + f""", ft AS (SELECT {KEYS}, CASE WHEN n_left%5=4 THEN 'omitted' WHEN n_left=2 AND kind='exec' THEN 'duplicate' WHEN n_right=3 THEN 'outcomes' WHEN n_right=1 AND kind='file' THEN 'category' END AS fault FROM ch
 UNION ALL SELECT {KEYS}, 'extra' FROM m WHERE left_outcomes = right_outcomes AND n_left + n_right = 4)
SELECT * FROM ft WHERE fault IS NOT NULL""")  # fmt: skip
def report_faults(spark, sf_dir):
    """A report with left-out, repeated, invented and altered changes against the events it came from."""
    events = trace_events(spark, sf_dir)
    left, right, is_exec = c("n_left"), c("n_right"), c("kind") == "exec"
    times = F.when(left % 5 == 4, 0).when((left == 2) & is_exec, 2).otherwise(1)
    rows = compare.changes(events).withColumn("right", F.when(right == 3, F.array(F.lit("EPERM"))).otherwise(c("right")))
    rows = rows.withColumn("change", F.when((right == 1) & ~is_exec, "Executable").otherwise(c("change")))
    rows = rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    cols = [*compare.KEY, "change", "left", "right"]
    alike = compare.merged(events).where(c("left").eqNullSafe(c("right")) & (left + right == 4)).withColumn("change", F.lit("FileAccessOutcome"))
    return audits.report_faults(events, rows.select(*cols).union(alike.select(*cols)))


KINDS = {
    "halves.mismatch": "resumed syscall does not match line [0-9]+$",
    "halves.exit": "^raw/trace.log:[0-9]+: unfinished call from line [0-9]+ ended with task",
    "halves.other": ": (replaced unfinished call|unmatched resumed call|unfinished call at end of trace)$",
    "input.abbreviated": ": abbreviated trace data;",
}


@query(LOG + WARNED + ", tx AS (SELECT run_id, 'raw/trace.log:' || place || said AS text FROM wn), tc AS (SELECT run_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in KINDS.items()) + " ELSE 'unclassified' END AS category FROM tx) SELECT run_id, category, count(*) AS n FROM tc GROUP BY ALL")
def warning_taxonomy(spark, sf_dir):
    return audits.warning_counts(parse.observations(raw_lines(spark, sf_dir)).warnings, KINDS)
