"""Turns the driver's ``events`` table into trace events of several pairs of runs.

A run is one side of a pair; ``pair_id`` comes first in every key, so one comparison
and thousands of them are the same plan. Calls of files and programs end up to SPAN - 1
lines after they begin. Only integers and strings are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS = 32
#: Lines over which a call may extend, in the numbering of the whole table.
SPAN = 400


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side, run_id, event_index, line, end_line, pid, kind, operation, path, outcome, child_pid, k."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "props")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    odd = F.col("event_id") % 2
    is_exit = (F.col("event_id") % 41).isin(39, 40)
    kind_of = {"purchase": "exec", "signup": "spawn", "click": "file", "view": "file", "error": "file"}
    operation_of = {"purchase": "execve", "signup": "fork", "click": "access", "view": "openat", "error": "openat"}
    pick = lambda names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    e = e.withColumn("k", k).withColumn("pair_id", F.col("user_id") % PAIRS).withColumn("side", F.when(odd == 0, "left").otherwise("right"))
    e = e.withColumn("kind", F.when(is_exit, "exit").otherwise(pick(kind_of))).withColumn("operation", F.when(is_exit, "exit").otherwise(pick(operation_of)))
    path = F.when(F.col("kind") == "exec", F.concat(F.lit("/bin/"), (F.col("k") % 20 + 2 * odd).cast("string"))).when(F.col("kind") == "file", F.concat(F.lit("/f/"), F.col("k").cast("string"), F.lit("/"), (F.col("user_id") % 7).cast("string")))
    failed = F.when(F.col("k") % 2 == 0, "ENOENT").otherwise("EACCES")
    outcome = F.when(is_exit, F.concat(F.lit("exited with "), (F.col("k") % 3).cast("string"))).when(F.col("event_type") == "error", failed).when((F.col("kind") == "exec") & (F.col("k") == 7), "ENOENT").otherwise("success")
    return e.select(
        "pair_id", "side", F.concat(F.col("pair_id").cast("string"), F.lit("-"), F.col("side")).alias("run_id"),
        F.col("event_id").alias("event_index"), (F.col("event_id") + 1).alias("line"), (F.col("event_id") + 1 + F.when(F.col("kind").isin("file", "exec"), F.col("k") % SPAN).otherwise(0)).alias("end_line"),
        F.col("user_id").cast("string").alias("pid"), "kind", "operation", path.alias("path"), outcome.alias("outcome"),
        F.when(F.col("kind") == "spawn", ((F.col("user_id") + F.col("k")) % 200).cast("string")).alias("child_pid"), "k",
    )


#: The same adapter for the SQL side, as the first common table expression ``t``.
SQL = f"""e AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props,'[0-9]+') AS INT) AS k FROM events),
t0 AS (SELECT *, user_id % {PAIRS} AS pair_id, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side,
 CASE WHEN event_id % 41 IN (39,40) THEN 'exit' WHEN event_type='purchase' THEN 'exec' WHEN event_type='signup' THEN 'spawn' WHEN event_type IN ('click','view','error') THEN 'file' END AS kind,
 CASE WHEN event_id % 41 IN (39,40) THEN 'exit' WHEN event_type='purchase' THEN 'execve' WHEN event_type='signup' THEN 'fork' WHEN event_type='click' THEN 'access' WHEN event_type IN ('view','error') THEN 'openat' END AS operation FROM e),
t AS (SELECT pair_id, side, CAST(pair_id AS VARCHAR) || '-' || side AS run_id, event_id AS event_index, event_id+1 AS line, event_id+1 + CASE WHEN kind IN ('file','exec') THEN k % {SPAN} ELSE 0 END AS end_line, CAST(user_id AS VARCHAR) AS pid, kind, operation,
 CASE WHEN kind='exec' THEN '/bin/' || CAST(k % 20 + 2*(event_id % 2) AS VARCHAR) WHEN kind='file' THEN '/f/' || CAST(k AS VARCHAR) || '/' || CAST(user_id % 7 AS VARCHAR) END AS path,
 CASE WHEN kind='exit' THEN 'exited with ' || CAST(k % 3 AS VARCHAR) WHEN event_type='error' THEN CASE WHEN k % 2 = 0 THEN 'ENOENT' ELSE 'EACCES' END WHEN kind='exec' AND k=7 THEN 'ENOENT' ELSE 'success' END AS outcome,
 CASE WHEN kind='spawn' THEN CAST((user_id + k) % 200 AS VARCHAR) END AS child_pid, k FROM t0)"""
