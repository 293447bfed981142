"""One query per operator group, over trace events adapted from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import decode
from runlens.operators import compare, contracts, lifecycle, noise, records, report
from runlens.operators.context import context_state
from runlens.sources.adapter import SQL, trace_events

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None, adapted: bool = True):
    """Register a query by its name; ``sql`` follows the adapter's common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {SQL}{',' if sql.lstrip()[0] != 'S' else ''} {sql}" if adapted else sql
        return f

    return add


KEYS = "pair_id, kind, operation, path"
COMPARABLE = "c AS (SELECT * FROM t WHERE kind IN ('file','exec') AND path IS NOT NULL)"
SETS = COMPARABLE + f", s AS (SELECT {KEYS}, side, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS outcomes, count(*) AS n_events FROM c GROUP BY ALL)"
MERGED = SETS + """, m AS (SELECT coalesce(l.pair_id,r.pair_id) AS pair_id, coalesce(l.kind,r.kind) AS kind, coalesce(l.operation,r.operation) AS operation, coalesce(l.path,r.path) AS path,
 coalesce(l.outcomes,'') AS left_outcomes, coalesce(r.outcomes,'') AS right_outcomes, coalesce(l.n_events,0) AS n_left, coalesce(r.n_events,0) AS n_right
 FROM (SELECT * FROM s WHERE side='left') l FULL OUTER JOIN (SELECT * FROM s WHERE side='right') r ON l.pair_id=r.pair_id AND l.kind=r.kind AND l.operation=r.operation AND l.path=r.path)"""
CHANGES = MERGED + """, ch0 AS (SELECT *, list_filter(string_split(concat_ws(',', nullif(left_outcomes,''), nullif(right_outcomes,'')), ','), lambda x: x <> 'success') AS failures FROM m WHERE left_outcomes <> right_outcomes),
ch1 AS (SELECT *, CASE WHEN kind='exec' THEN CASE WHEN len(failures)>0 THEN 'ExecutionAttempt' ELSE 'Executable' END WHEN left_outcomes='' THEN 'NewFileAccess' WHEN right_outcomes='' THEN 'RemovedFileAccess' ELSE 'FileAccessOutcome' END AS change FROM ch0),
ch AS (SELECT *, CASE WHEN left_outcomes='success' AND right_outcomes<>'' AND NOT list_contains(string_split(right_outcomes,','),'success') THEN 3 WHEN change='ExecutionAttempt' AND right_outcomes<>'' AND NOT list_contains(string_split(right_outcomes,','),'success') THEN 4 WHEN change='Executable' AND right_outcomes<>'' THEN 5 WHEN change='NewFileAccess' THEN 6 WHEN change='Executable' THEN 7 WHEN change IN ('FileAccessOutcome','ExecutionAttempt') THEN 8 ELSE 9 END AS rank_class FROM ch1)"""
RANKED = CHANGES + """, rk0 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY kind, operation, path) AS comparison_order FROM ch),
rk AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY rank_class, comparison_order) AS rank FROM rk0)"""
PRESENTED = RANKED + """, dg AS (SELECT *, CASE WHEN kind<>'file' OR (left_outcomes<>'' AND right_outcomes<>'') THEN NULL WHEN NOT list_contains(string_split(left_outcomes || ',' || right_outcomes, ','),'success') THEN 'One-sided unsuccessful file accesses (not necessarily faults)' WHEN regexp_matches(path,'(^|/)(rustc|rmeta|\\.tmp)[A-Za-z0-9]{6}(/|$)') THEN 'Temporary-looking file paths (heuristic, not ignored)' END AS detail_group FROM rk),
pr AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN detail_group IS NOT NULL THEN 10 ELSE rank_class END, comparison_order) AS position FROM dg)"""
# Coordinates are made coarse, so that events of a key share some of them.
COARSE = 2000
SAMPLES = CHANGES + f""", cc AS (SELECT * REPLACE (line - line % {COARSE} AS line, line - line % {COARSE} AS end_line) FROM c),
q0 AS (SELECT cc.*, list_contains(string_split(CASE WHEN cc.side='left' THEN ch.right_outcomes ELSE ch.left_outcomes END, ','), cc.outcome) AS shared, row_number() OVER (PARTITION BY cc.pair_id, cc.kind, cc.operation, cc.path, cc.side, cc.outcome ORDER BY cc.event_index) AS nth FROM cc JOIN ch ON cc.pair_id=ch.pair_id AND cc.kind=ch.kind AND cc.operation=ch.operation AND cc.path=ch.path),
q1 AS (SELECT *, CASE WHEN shared THEN 2 WHEN nth=1 THEN 1 ELSE 3 END AS pass FROM q0),
qt AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, side, line, end_line ORDER BY pass, outcome, event_index) AS twin FROM q1),
q2 AS (SELECT *, row_number() OVER (PARTITION BY {KEYS}, side ORDER BY pass, outcome, event_index) AS slot FROM qt WHERE pass<3 OR twin=1),
q AS (SELECT {KEYS}, side, slot, outcome, event_index, line, end_line FROM q2 WHERE slot <= 3)"""
TIMELINE = """a AS (SELECT pair_id, run_id, line, end_line, event_index, pid AS task, 0 AS seq, CASE WHEN kind='exit' THEN 'X' ELSE 'A' END AS kind_, event_index = first_value(event_index) OVER (PARTITION BY run_id ORDER BY line, end_line, event_index) AS is_first FROM t
 UNION ALL SELECT pair_id, run_id, line, end_line, event_index, child_pid, 1, 'C', false FROM t WHERE kind='spawn' AND outcome='success' AND child_pid IS NOT NULL),
b AS (SELECT *, lag(kind_) OVER (PARTITION BY run_id, task ORDER BY line, end_line, event_index, seq) AS before_ FROM a),
o AS (SELECT *, kind_='C' OR before_ IS NULL OR before_='X' AS opens FROM b),
tl AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, task ORDER BY line, end_line, event_index, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ordinal,
 CASE WHEN NOT opens THEN NULL WHEN kind_='C' THEN CASE WHEN before_ IN ('A','C') THEN 'LiveCollision' ELSE 'Spawned' END WHEN before_='X' THEN 'Reappeared' WHEN is_first THEN 'Initial' ELSE 'Unintroduced' END AS origin FROM o)"""
GENERATIONS = TIMELINE + """, g AS (SELECT pair_id, run_id, task, ordinal, max(origin) AS origin, arg_min(event_index, line) FILTER (WHERE kind_<>'C') AS first_event, max(event_index) FILTER (WHERE kind_='X') AS exit_event, count(*) AS n_rows FROM tl GROUP BY ALL)"""
CALLS = COMPARABLE + ", cl AS (SELECT pair_id, side, operation, path, count(*) AS n FROM c GROUP BY ALL)"
JOINED = ["left", "right"]


def _coarse(events: DataFrame) -> DataFrame:
    block = F.col("line") - F.col("line") % COARSE
    return events.withColumn("end_line", block).withColumn("line", block)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("left_outcomes", F.array_join("left", ",")).withColumn("right_outcomes", F.array_join("right", ",")).drop(*JOINED)


@query(COMPARABLE + " SELECT run_id, event_index, kind, operation, path, outcome FROM c")
def comparable_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.comparable(trace_events(spark, sf_dir)).select("run_id", "event_index", "kind", "operation", "path", "outcome")


@query(SETS + " SELECT * FROM s")
def outcome_sets(spark, sf_dir):
    return compare.outcome_sets(trace_events(spark, sf_dir)).withColumn("outcomes", F.array_join("outcomes", ","))


@query(MERGED + " SELECT * FROM m")
def diff_full_outer(spark, sf_dir):
    return _flat(compare.merged(trace_events(spark, sf_dir)))


@query(CHANGES + f" SELECT {KEYS}, left_outcomes, right_outcomes, n_left, n_right, change, rank_class FROM ch")
def diff_categories(spark, sf_dir):
    return _flat(compare.changes(trace_events(spark, sf_dir)))


@query(RANKED + f" SELECT {KEYS}, left_outcomes, right_outcomes, n_left, n_right, change, rank_class, comparison_order, rank FROM rk")
def diff_ranked(spark, sf_dir):
    return _flat(compare.ranked(trace_events(spark, sf_dir)))


@query(CHANGES + " SELECT change, count(*) AS n FROM ch GROUP BY change")
def category_histogram(spark, sf_dir):
    return compare.changes(trace_events(spark, sf_dir)).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(COMPARABLE + f", d AS (SELECT DISTINCT {KEYS}, side, outcome FROM c) SELECT {KEYS}, side, outcome FROM d WHERE NOT EXISTS (SELECT 1 FROM d x WHERE x.side<>d.side AND x.pair_id=d.pair_id AND x.kind=d.kind AND x.operation=d.operation AND x.path=d.path AND x.outcome=d.outcome)")
def side_only_outcomes(spark, sf_dir):
    rows = compare.comparable(trace_events(spark, sf_dir)).groupBy(*compare.KEY, "outcome").agg(F.min("side").alias("side"), F.max("side").alias("last"))
    return rows.where("side = last").drop("last")


@query(SAMPLES + " SELECT * FROM q")
def evidence_samples(spark, sf_dir):
    return compare.evidence_samples(_coarse(trace_events(spark, sf_dir)))


@query(SAMPLES + f", k AS (SELECT {KEYS}, side, count(*) AS n_sampled FROM q GROUP BY ALL) SELECT s.*, k.n_sampled, s.n_events - k.n_sampled AS n_omitted FROM (SELECT {KEYS}, side, n_events FROM s) s JOIN k USING ({KEYS}, side)")
def outcome_mapping_counts(spark, sf_dir):
    return compare.mapping_counts(_coarse(trace_events(spark, sf_dir)))


@query(PRESENTED + f" SELECT {KEYS}, rank_class, detail_group FROM dg")
def detail_groups(spark, sf_dir):
    return compare.detail_groups(trace_events(spark, sf_dir)).select(*compare.KEY, "rank_class", "detail_group")


@query(PRESENTED + f" SELECT {KEYS}, change, position FROM pr")
def presented_positions(spark, sf_dir):
    return compare.presented(trace_events(spark, sf_dir)).select(*compare.KEY, "change", "position")


@query(PRESENTED + " SELECT pair_id, detail_group, count(*) AS n, array_to_string(list_slice(list(position ORDER BY position),1,3),',') AS first_positions FROM pr WHERE position>5 AND detail_group IS NOT NULL GROUP BY ALL")
def folded_summary(spark, sf_dir):
    return compare.folded(trace_events(spark, sf_dir))


@query(GENERATIONS + " SELECT run_id, task, ordinal, first_event, n_rows FROM g")
def generations(spark, sf_dir):
    return lifecycle.generations(trace_events(spark, sf_dir)).select("run_id", "task", "ordinal", "first_event", "n_rows")


@query(GENERATIONS + " SELECT run_id, origin, count(*) AS n FROM g GROUP BY ALL")
def generation_origins(spark, sf_dir):
    return lifecycle.generations(trace_events(spark, sf_dir)).groupBy("run_id", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(GENERATIONS + " SELECT tl.run_id, tl.event_index, tl.task AS pid, tl.ordinal, g.origin FROM tl JOIN g USING (run_id, task, ordinal) WHERE kind_<>'C' AND g.origin IN ('Unintroduced','Reappeared','LiveCollision')")
def untrusted_events(spark, sf_dir):
    return lifecycle.untrusted_events(trace_events(spark, sf_dir))


@query(GENERATIONS + " SELECT run_id, task, ordinal, first_event, exit_event FROM g WHERE exit_event IS NOT NULL")
def generation_bounds(spark, sf_dir):
    return lifecycle.generations(trace_events(spark, sf_dir)).where("exit_event is not null").select("run_id", "task", "ordinal", "first_event", "exit_event")


@query(GENERATIONS + ", lb AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY run_id, task) > 1 THEN task || '#' || CAST(ordinal AS VARCHAR) ELSE task END AS label FROM g) SELECT run_id, count(*) AS n_missing, string_agg(label, ', ' ORDER BY label) AS missing FROM lb WHERE exit_event IS NULL GROUP BY run_id")
def missing_exits(spark, sf_dir):
    return lifecycle.missing_exits(trace_events(spark, sf_dir))


@query(GENERATIONS + ", r AS (SELECT run_id, arg_min(event_index, line) AS root_event, arg_min(pid, line) AS root_pid FROM t WHERE kind='exec' AND outcome='success' GROUP BY run_id) SELECT r.*, tl.ordinal, g.exit_event FROM r JOIN tl ON tl.run_id=r.run_id AND tl.event_index=r.root_event AND tl.kind_<>'C' JOIN g ON g.run_id=r.run_id AND g.task=tl.task AND g.ordinal=tl.ordinal")
def root_exec(spark, sf_dir):
    return lifecycle.root_exec(trace_events(spark, sf_dir))


@query("SELECT f.run_id, f.event_index, f.pid, (SELECT max_by(x.path, x.end_line * 1000000 + x.event_index) FROM t x WHERE x.run_id=f.run_id AND x.pid=f.pid AND x.kind='exec' AND x.outcome='success' AND x.end_line<=f.line) AS exec_path FROM t f WHERE f.kind='file'")
def exec_before_asof(spark, sf_dir):
    return lifecycle.exec_before(trace_events(spark, sf_dir))


EDGES = "w AS (SELECT run_id, line, pid AS parent, child_pid AS child FROM t WHERE kind='spawn' AND outcome='success'), ed AS (SELECT w.*, (SELECT max(p.line) FROM w p WHERE p.run_id=w.run_id AND p.child=w.parent AND p.line<w.line) AS parent_line FROM w)"


@query(EDGES + " SELECT * FROM ed")
def spawn_edges(spark, sf_dir):
    return lifecycle.spawn_edges(trace_events(spark, sf_dir))


@query("RECURSIVE " + EDGES + ", lin AS (SELECT run_id, line, child, line AS root_line, CAST(0 AS BIGINT) AS depth FROM ed WHERE parent_line IS NULL UNION ALL SELECT ed.run_id, ed.line, ed.child, lin.root_line, lin.depth+1 FROM ed JOIN lin ON ed.run_id=lin.run_id AND ed.parent_line=lin.line) SELECT * FROM lin")
def process_lineage(spark, sf_dir):
    return lifecycle.lineage(trace_events(spark, sf_dir))


ORACLE_SQL["process_lineage"] = ORACLE_SQL["process_lineage"].replace("WITH e AS", "WITH RECURSIVE e AS", 1).replace(", RECURSIVE w AS", ", w AS", 1)


@query("SELECT run_id, count(*) AS n_events, max(end_line) AS max_line, bool_or(end_line<line) AS bad_order, bool_or(path IS NULL AND kind IN ('file','exec')) AS lacks_path, count(DISTINCT pid) AS n_pids, min(event_index) FILTER (WHERE outcome<>'success' AND kind<>'exit') AS first_failure, arg_min(operation, event_index) FILTER (WHERE outcome<>'success' AND kind<>'exit') AS first_failed_operation FROM t GROUP BY run_id")
def event_facts(spark, sf_dir):
    return contracts.event_facts(trace_events(spark, sf_dir))


@query("z AS (SELECT *, CASE WHEN k=3 THEN 'x' || pid ELSE pid END AS p, CASE WHEN k=5 THEN 'relative' WHEN k=6 AND path IS NOT NULL THEN 'f' ELSE path END AS q FROM t) SELECT run_id, event_index, error FROM (SELECT *, CASE WHEN NOT regexp_matches(p,'^[0-9]+$') THEN 'pid' WHEN kind IN ('file','exec') AND q IS NOT NULL AND NOT starts_with(q,'/') AND NOT starts_with(q,'relative:') THEN 'path neither absolute nor relative' END AS error FROM z) WHERE error IS NOT NULL")
def shape_errors(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    broken = e.withColumn("pid", F.when(F.col("k") == 3, F.concat(F.lit("x"), "pid")).otherwise(F.col("pid"))).withColumn("path", F.when(F.col("k") == 5, "relative").when((F.col("k") == 6) & F.col("path").isNotNull(), "f").otherwise(F.col("path")))
    return contracts.shape_errors(broken)


@query("SELECT path, CAST(i-1 AS INT) AS at, tok[i] AS token FROM (SELECT path, regexp_extract_all(path,'[^/._-]+|[/._-]') AS tok FROM (SELECT DISTINCT path FROM t WHERE path IS NOT NULL)) x, unnest(range(1, len(tok)+1)) AS u(i)")
def path_slots(spark, sf_dir):
    return noise.path_slots(trace_events(spark, sf_dir).where("path is not null").select("path").distinct())


@query(CALLS + """, sl AS (SELECT pair_id, side, operation, n, string_split(path,'/') AS parts, i AS ix FROM cl, unnest(range(1, len(string_split(path,'/'))+1)) AS u(i)),
sv AS (SELECT *, parts[ix] AS value, array_to_string(list_transform(parts, lambda p, j: CASE WHEN j=ix THEN '*' ELSE p END),'/') AS pattern FROM sl WHERE parts[ix]<>''),
fam AS (SELECT pair_id, operation, pattern, list(value ORDER BY value) FILTER (WHERE side='left') AS lv, list(value ORDER BY value) FILTER (WHERE side='right') AS rv, list(n ORDER BY n) FILTER (WHERE side='left') AS ln, list(n ORDER BY n) FILTER (WHERE side='right') AS rn FROM sv GROUP BY ALL)
SELECT pair_id, operation, pattern, len(lv) AS n_left, array_to_string(lv,',') AS left_values, array_to_string(rv,',') AS right_values FROM fam WHERE len(lv)>=2 AND len(rv)>=2 AND NOT list_has_any(lv,rv) AND ln=rn""")
def recurring_families(spark, sf_dir):
    return noise.recurring_families(trace_events(spark, sf_dir))


@query(CALLS + """, pf AS (SELECT *, regexp_extract(path,'^(/[^/]*/[^/]*)/',1) AS prefix, regexp_extract(path,'^/[^/]*/[^/]*(/.*)$',1) AS rest FROM cl),
un AS (SELECT * FROM pf WHERE prefix<>'' QUALIFY count(*) OVER (PARTITION BY pair_id, side, operation, n, rest)=1)
SELECT l.pair_id, l.prefix AS left_prefix, r.prefix AS right_prefix, count(*) AS n_shared FROM un l JOIN un r ON l.side='left' AND r.side='right' AND l.pair_id=r.pair_id AND l.operation=r.operation AND l.n=r.n AND l.rest=r.rest WHERE l.prefix<>r.prefix GROUP BY ALL HAVING count(*)>=1""")
def paired_subtrees(spark, sf_dir):
    return noise.paired_subtrees(trace_events(spark, sf_dir), least=1)


@query("SELECT pair_id, kind, outcome, CAST(sum(CASE WHEN side='left' THEN 1 ELSE 0 END) AS BIGINT) AS n_left, CAST(sum(CASE WHEN side='right' THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM t GROUP BY ALL")
def outcome_crosstab(spark, sf_dir):
    return noise.outcome_crosstab(trace_events(spark, sf_dir))


@query(CALLS + " SELECT side, n AS n_calls, count(*) AS n_keys, count(DISTINCT path) AS n_paths FROM cl GROUP BY side, n")
def calls_histogram(spark, sf_dir):
    return noise.calls_histogram(trace_events(spark, sf_dir))


@query("SELECT pair_id, operation, outcome, CAST(sum(CASE WHEN side='left' THEN 1 ELSE -1 END) AS BIGINT) AS surplus FROM t GROUP BY ALL HAVING sum(CASE WHEN side='left' THEN 1 ELSE -1 END)<>0")
def multiset_equality(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    part = lambda s: e.where(F.col("side") == s).select("pair_id", "operation", "outcome")
    return noise.multiset_difference(part("left"), part("right"))


@query(COMPARABLE + ", l AS (SELECT DISTINCT pair_id, path FROM c WHERE side='left'), r AS (SELECT DISTINCT pair_id, path FROM c WHERE side='right') SELECT 'left' AS side, * FROM (FROM l EXCEPT FROM r) UNION ALL SELECT 'right', * FROM (FROM r EXCEPT FROM l)")
def symmetric_difference(spark, sf_dir):
    rows = compare.comparable(trace_events(spark, sf_dir)).groupBy("pair_id", "path").agg(F.min("side").alias("side"), F.max("side").alias("last"))
    return rows.where("side = last").select("side", "pair_id", "path")


@query("SELECT f.run_id, f.event_index, (SELECT count(*) FROM t x WHERE x.run_id=f.run_id AND x.pid=f.pid AND x.line>f.line AND x.line<f.end_line) AS n_between FROM t f WHERE f.end_line>f.line")
def interval_gaps(spark, sf_dir):
    return noise.interval_gaps(trace_events(spark, sf_dir))


@query("SELECT event_index, CASE WHEN k % 5=0 THEN NULL WHEN k % 5=1 THEN 512 WHEN k % 5=2 THEN 17 WHEN k % 5=3 THEN 256+131072 ELSE 512+131072 END AS bits, CASE WHEN k % 5=0 OR k % 5=4 THEN 'Unknown' WHEN k % 5=1 THEN 'SharedFs' WHEN k % 5=2 THEN 'PrivateFs' ELSE 'PrivateFsNamespaceUncertain' END AS effect FROM t WHERE kind='spawn'")
def flag_decode(spark, sf_dir):
    spelled = F.element_at(F.array(*map(F.lit, ["CLONE_VM|CLONE_NOSUCH", "0x200", "SIGCHLD", "CLONE_VM|CLONE_NEWNS", "CLONE_FS | CLONE_NEWNS"])), (F.col("k") % 5 + 1).cast("int"))
    from runlens.functions.vocab import CLONE_FLAGS, SIGNALS

    rows = trace_events(spark, sf_dir).where("kind = 'spawn'").withColumn("bits", decode.symbolic_bits(spelled, CLONE_FLAGS | SIGNALS))
    return rows.select("event_index", "bits", decode.spawn_effect(F.col("bits")).alias("effect"))


@query("SELECT event_index, CASE WHEN k % 4=0 THEN 9 WHEN k % 4=1 THEN 34 + k % 30 WHEN k % 4=2 THEN 32 + k % 30 END AS signal FROM t WHERE kind='exit'")
def signal_names(spark, sf_dir):
    k = F.col("k")
    name = F.when(k % 4 == 0, "SIGKILL").when(k % 4 == 1, F.concat(F.lit("SIGRTMIN+"), (k % 30).cast("string"))).when(k % 4 == 2, F.concat(F.lit("SIGRT_"), (k % 30).cast("string"))).otherwise("SIGNONE")
    rows = trace_events(spark, sf_dir).where("kind = 'exit'")
    return rows.select("event_index", decode.exit_fields(F.concat(F.lit("killed by "), name, F.lit(" (core dumped)")))["signal"].alias("signal"))


@query("SELECT event_index, pid, operation, path, outcome FROM t WHERE kind='file'")
def raw_line_roundtrip(spark, sf_dir):
    e = trace_events(spark, sf_dir).where("kind = 'file'")
    spelled = F.regexp_replace(F.hex(F.encode("path", "UTF-8")), "(..)", r"\\x$1")
    text = F.concat("pid", F.lit(" "), "operation", F.lit('(AT_FDCWD, "'), spelled, F.lit('", O_RDONLY) = '), F.when(F.col("outcome") == "success", "3").otherwise(F.concat(F.lit("-1 "), "outcome", F.lit(" (failed)"))))
    rows = e.select("event_index", decode.line_parts(text).alias("p")).withColumn("call", decode.call_parts(F.col("p.body")))
    return rows.select("event_index", "p.pid", decode.operation(F.col("p.body")).alias("operation"), decode.resolved_path(F.col("call.args")).alias("path"), decode.outcome(F.col("call.returned")).alias("outcome"))


LINES = "ln AS (SELECT run_id, line, pid, kind, CASE WHEN kind='exit' THEN 'X' WHEN k % 3=0 THEN 'U' WHEN k % 3=1 THEN 'R' ELSE 'C' END AS tt, CASE WHEN k % 2=0 THEN 'openat' ELSE 'access' END AS op FROM t)"


@query(LINES + """, st AS (SELECT *, lag(CASE WHEN tt<>'C' THEN tt END IGNORE NULLS) OVER w AS lt, lag(CASE WHEN tt<>'C' THEN line END IGNORE NULLS) OVER w AS ll, lag(CASE WHEN tt<>'C' THEN op END IGNORE NULLS) OVER w AS lo, lead(CASE WHEN tt<>'C' THEN tt END IGNORE NULLS) OVER w AS nt FROM ln WINDOW w AS (PARTITION BY run_id, pid ORDER BY line)),
sr AS (SELECT *, CASE WHEN tt='R' AND coalesce(lt,'')<>'U' THEN 'unmatched resumed' WHEN tt='R' AND lo<>op THEN 'resumed mismatch' WHEN tt='R' THEN 'stitched' WHEN tt='U' AND nt IS NULL THEN 'unfinished at end' WHEN tt='U' AND nt='U' THEN 'replaced' WHEN tt='U' AND nt='X' THEN 'ended with exit' WHEN tt='C' THEN 'complete' END AS state FROM st)
SELECT run_id, pid, op, CASE WHEN state='stitched' THEN ll ELSE line END AS line, line AS end_line, state FROM sr WHERE state IS NOT NULL""")
def stitched_calls(spark, sf_dir):
    k = F.col("k")
    rows = trace_events(spark, sf_dir).select("run_id", "line", "pid", F.when(F.col("kind") == "exit", "X").when(k % 3 == 0, "U").when(k % 3 == 1, "R").otherwise("C").alias("t"), F.when(k % 2 == 0, "openat").otherwise("access").alias("op"))
    return lifecycle.stitched(rows)


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text='' OR right(text,1)=chr(10) THEN 0 ELSE 1 END AS BIGINT) AS n_lines FROM documents", adapted=False)
def document_checksums(spark, sf_dir):
    text = F.col("text")
    ends = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))
    tail = F.when((text == "") | text.endswith("\n"), 0).otherwise(1)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), (ends + tail).cast("long").alias("n_lines"))


@query("""WITH v AS (SELECT CAST(n_nationkey AS BIGINT) AS pair_id, n_regionkey AS g FROM nation),
x AS (SELECT *, CASE WHEN g=0 THEN '(unset)' ELSE 'value="' || CAST(g AS VARCHAR) || '"' END AS before, CASE WHEN g=2 OR g=4 THEN '(not selected/unknown)' ELSE 'value="1"' END AS after FROM v)
SELECT pair_id, 'A' AS name, before, after FROM x WHERE before<>after UNION ALL SELECT pair_id, 'B', 'value="a\\"b\\n"', '(not selected/unknown)' FROM v WHERE g=4""", adapted=False)
def env_three_valued(spark, sf_dir):
    g = F.col("n_regionkey")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    same = F.lit('a"b\n')
    left = F.create_map(F.lit("A"), F.when(g != 0, g.cast("string")), F.lit("B"), same)
    right = F.when(g == 2, F.create_map(F.lit("B"), same)).when(g != 4, F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), same))
    return compare.environment_changes(rows.select(F.col("n_nationkey").cast("long").alias("pair_id"), left.alias("left"), right.alias("right")))


@query("""f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7=0 THEN 2 END AS rs, CASE WHEN o_orderkey % 5<>0 THEN o_orderkey % 3 END AS tc, CASE WHEN o_orderkey % 10=0 THEN 15 END AS ts, CASE WHEN o_orderkey % 11<>0 THEN CASE WHEN o_orderkey % 10=0 THEN 143 ELSE o_orderkey % 3 END END AS cc, o_orderkey % 13=0 AS lim, o_orderkey % 4 AS nw FROM orders),
h AS (SELECT *, coalesce(tc, 128+ts) AS tg FROM f), i AS (SELECT *, CASE WHEN rs IS NOT NULL THEN 'interrupted' WHEN tg IS NULL OR cc IS NULL OR lim OR cc<>tg THEN 'capture_failed' ELSE 'completed' END AS state FROM h)
SELECT id AS run_id, state, CASE WHEN state<>'completed' THEN 'incomplete' WHEN nw=0 THEN 'complete_for_supported_events' ELSE 'partial' END AS completeness, CAST(CASE WHEN state='interrupted' THEN 128+rs WHEN state='capture_failed' THEN 125 ELSE coalesce(tg,cc,125) END AS INT) AS exit_code FROM i""".replace("f AS", "WITH f AS", 1), adapted=False)
def capture_reduction(spark, sf_dir):
    o = F.col("o_orderkey")
    facts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        o.alias("run_id"), F.when(o % 7 == 0, 2).alias("recorder_signal"), F.when(o % 5 != 0, o % 3).alias("target_code"), F.when(o % 10 == 0, 15).alias("target_signal"),
        F.when(o % 11 != 0, F.when(o % 10 == 0, F.lit(143).cast("long")).otherwise(o % 3)).alias("collector_code"), (o % 13 == 0).alias("limit_hit"), (o % 4).alias("n_warnings"),
    )
    return contracts.reduce_capture(facts)


@query(CHANGES + ", nc AS (SELECT pair_id, count(*) AS n_changes FROM ch GROUP BY pair_id), pp AS (SELECT DISTINCT pair_id FROM t) SELECT pp.pair_id, coalesce(nc.n_changes,0) AS n_changes, CASE WHEN pp.pair_id=1 THEN 2 WHEN pp.pair_id IN (2,3) THEN 3 WHEN coalesce(nc.n_changes,0)>0 THEN 1 ELSE 0 END AS exit_code FROM pp LEFT JOIN nc USING (pair_id)")
def exit_status(spark, sf_dir):
    e = trace_events(spark, sf_dir)
    p = F.col("pair_id")
    sides = e.select("pair_id", "side").distinct().select("pair_id", "side", (p != 1).alias("loaded"), F.when(p == 2, "partial").otherwise("complete").alias("capture"), F.when(p == 3, "unverified").otherwise("verified").alias("storage"), F.lit(None).cast("string").alias("raw"), F.lit("verified").alias("provenance"))
    counts = compare.changes(e).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_changes"))
    return compare.report_status(sides, counts)


@query("SELECT doc_id, regexp_matches(p,'(^|/)(rustc|rmeta|\\.tmp)[A-Za-z0-9]{6}(/|$)') AS is_temporary FROM (SELECT doc_id, '/t/' || CASE WHEN doc_id % 3=0 THEN 'rustc' ELSE 'lib' END || substr('abcdef0',1,CAST(4+doc_id % 4 AS INT)) || '/x' AS p FROM documents)", adapted=False)
def temporary_paths(spark, sf_dir):
    d = F.col("doc_id")
    path = F.concat(F.lit("/t/"), F.when(d % 3 == 0, "rustc").otherwise("lib"), F.substring(F.lit("abcdef0"), F.lit(1), (d % 4 + 4).cast("int")), F.lit("/x"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", compare.temporary(path).alias("is_temporary"))


@query()
def context_state_machine(spark, sf_dir):
    return context_state(trace_events(spark, sf_dir))


CHANGED = """WITH o AS (SELECT o_orderkey AS pair_id, o_orderkey % 8 AS k FROM orders)
SELECT pair_id, 0 AS seq, 'ExitStatus' AS change, '' AS subject, 'code=Some(0), signal=None' AS before, CASE k WHEN 1 THEN 'code=Some(2), signal=None' WHEN 2 THEN 'code=None, signal=Some(9)' ELSE 'code=None, signal=None, raw="+++ killed by SIGODD +++"' END AS after FROM o WHERE k IN (1,2,3)
UNION ALL SELECT pair_id, 1, 'InitialWorkingDirectory', '', '/w', '/v' FROM o WHERE k=4
UNION ALL SELECT pair_id, 2, 'CommandArguments', '', '["make"]', '["make", "a\\"b"]' FROM o WHERE k=5
UNION ALL SELECT pair_id, 3, 'CaptureCompleteness', '', 'completed; complete_for_supported_events; 0 warnings', 'completed; partial; 1 warnings' FROM o WHERE k=6
UNION ALL SELECT pair_id, 4, 'SelectedStartupEnvironment', 'A', 'value="1"', '(unset)' FROM o WHERE k=7"""


def _run(k, changed):
    """A run's metadata as a struct; with ``changed`` one fact differs by k."""
    on = lambda i: (k == i) if changed else F.lit(False)
    words = lambda *w: F.array(*map(F.lit, w))
    return F.struct(
        F.when(on(1), 2).when(on(2) | on(3), None).otherwise(0).alias("exit_code"), F.when(on(2), 9).alias("signal"), F.when(on(3), "+++ killed by SIGODD +++").otherwise("+++ exited with 0 +++").alias("target_exit_raw"),
        F.when(on(4), "/v").otherwise("/w").alias("cwd"), F.when(on(5), words("make", 'a"b')).otherwise(words("make")).alias("command"), F.lit("completed").alias("state"),
        F.when(on(6), "partial").otherwise("complete_for_supported_events").alias("completeness"), F.when(on(6), words("w")).otherwise(F.array().cast("array<string>")).alias("warnings"),
        F.create_map(F.lit("A"), F.when(~on(7), "1")).alias("environment"),
    )


@query(CHANGED, adapted=False)
def metadata_changes(spark, sf_dir):
    k = F.col("o_orderkey") % 8
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pair_id"), _run(k, False).alias("left"), _run(k, True).alias("right"))
    rows = report.metadata_changes(pairs)
    return rows.select("pair_id", "seq", "change", "subject", F.col("left")[0].alias("before"), F.col("right")[0].alias("after"))


@query("""WITH o AS (SELECT o_orderkey AS run_id, o_orderkey % 7 AS k FROM orders) SELECT run_id, CASE k WHEN 1 THEN 'current exit code must be in 0..=255' WHEN 2 THEN 'ID is not one safe generated component' WHEN 3 THEN 'unknown capture state'
WHEN 4 THEN 'partial metadata records no evidence limitation' WHEN 6 THEN 'historical metadata cannot claim trace-v1 facts' END AS error FROM o WHERE k IN (1,2,3,4,6)""", adapted=False)
def metadata_contract(spark, sf_dir):
    from runlens.sources.trace import PROVENANCE

    k = F.col("o_orderkey") % 7
    code = F.when(k == 1, 256).otherwise(0)
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("run_id"), F.when(k == 5, 2).otherwise(3).alias("schema_version"), F.lit("1").alias("tool_version"), F.when(k.isin(2, 5), "../x").otherwise("ab1-7").alias("id"), F.lit("n").alias("name"),
        F.array(F.lit("make")).alias("command"), F.lit("/w").alias("cwd"), F.lit("b").alias("backend"), F.lit(2).alias("ended"), F.when(k == 3, "odd").otherwise("completed").alias("state"), code.alias("exit_code"), code.alias("collector_exit_code"),
        F.lit(None).cast("int").alias("signal"), F.lit(None).cast("int").alias("collector_signal"), F.array().cast("array<string>").alias("warnings"), F.lit(1).alias("parsed_events"), F.lit(1).alias("raw_lines"),
        F.create_map().cast("map<string,string>").alias("environment"), F.when(k == 4, "partial").otherwise("complete_for_supported_events").alias("completeness"), F.lit("+++ exited with 0 +++").alias("target_exit_raw"),
        F.when(k == 6, "trace-v1").alias("evidence_contract"), F.lit(None).cast(PROVENANCE).alias("target_provenance"),
    )
    return runs.select("run_id", contracts.first_failure(records.metadata_rules()).alias("error")).where("error is not null")


@query(CHANGES + f", mp AS (SELECT c.* FROM c JOIN ch ON c.pair_id=ch.pair_id AND c.kind=ch.kind AND c.operation=ch.operation AND c.path=ch.path) SELECT {KEYS}, side, outcome, count(*) AS event_count, string_agg(CAST(event_index AS VARCHAR), ',' ORDER BY event_index) AS indices FROM mp GROUP BY ALL")
def outcome_references(spark, sf_dir):
    rows = report.mapping(trace_events(spark, sf_dir))
    return rows.withColumn("indices", F.array_join(F.transform("events", lambda e: e["index"].cast("string")), ",")).drop("events")


@query()
def report_text(spark, sf_dir):
    """Text reports of all pairs, with run facts that are equal on both sides."""
    from runlens.sources.trace import METADATA

    e = trace_events(spark, sf_dir)
    runs = e.groupBy("pair_id", "side", "run_id").agg(F.count(F.lit(1)).alias("parsed_events"), F.max("end_line").alias("raw_lines"))
    given = {
        "schema_version": F.lit(3), "tool_version": F.lit("1"), "id": F.concat(F.lit("a"), F.col("pair_id").cast("string"), F.when(F.col("side") == "left", "-1").otherwise("-2")), "name": F.col("run_id"),
        "command": F.array(F.lit("make")), "cwd": F.lit("/w"), "started": F.lit(1), "ended": F.lit(2), "backend": F.lit("trace"), "state": F.lit("completed"), "exit_code": F.lit(0), "warnings": F.array().cast("array<string>"),
        "parsed_events": F.col("parsed_events"), "raw_lines": F.col("raw_lines"), "environment": F.create_map().cast("map<string,string>"), "completeness": F.lit("complete_for_supported_events"), "collector_exit_code": F.lit(0), "target_exit_raw": F.lit("+++ exited with 0 +++"),
    }
    none = {"raw": "string", "raw_detail": "string", "load_error": "string", "load_kind": "string", "unsupported_schema": "int", "shape_error": "string", "manifest": "struct<schema_version:int,run_id:string,file:string,receipt:struct<status:string,bytes:bigint,logical_lines:bigint,sha256:string,reason:string>>"}
    facts = {"n_events": F.col("parsed_events"), "max_line": F.col("raw_lines"), "has_non_v3": F.lit(True)} | {n: F.lit(False) for n in ("has_non_v2", "has_v3", "bad_order", "any_uncertain", "argv_missing", "incomplete")}
    sides = runs.select("pair_id", "side", F.lit("verified").alias("storage"), F.lit("verified").alias("storage_detail"), *(F.lit(None).cast(t).alias(n) for n, t in none.items()), *(x.alias(n) for n, x in facts.items()), *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields))
    done, found = report.report(sides, e)
    return report.text(done, found)


ENTRY = diff_ranked
